"""Fill-in-the-middle: texts are cut in prefix, middle and suffix and put in another order.

Each text becomes a rope, is split at two ranks of units, and the parts are joined anew behind
sentinels; the inverse splits the output's rope at its sentinels.  Ranks and forms follow from
a hash of seed and doc_id, so reruns and other engines agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import rope
from tallyforge.llm.stages import give_back

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percent of the texts that are rearranged, and of these what goes suffix first.
SEED, RATE, SPM_RATE = 42, 50, 80
#: Rows that are worked on and sent at a time.
SLICE = 500


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The four 32-bit numbers of a document; a missing id counts as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transform(text: str, numbers: list[int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), output."""
    whole = rope.build(text)
    h1, h2, h3, h4 = numbers
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return whole.units, PLAIN, None, None, text
    lo, hi = sorted((h1 % (whole.units + 1), h2 % (whole.units + 1)))
    rest, suffix = rope.split_units(whole, hi)
    prefix, middle = rope.split_units(rest, lo)
    sentinel = {x: rope.leaf(x) for x in (PREFIX, SUFFIX, MIDDLE)}
    if h4 % 100 < spm_rate:
        form, order = SPM, (sentinel[SUFFIX], suffix, sentinel[PREFIX], prefix, sentinel[MIDDLE], middle)
    else:
        form, order = PSM, (sentinel[PREFIX], prefix, sentinel[SUFFIX], suffix, sentinel[MIDDLE], middle)
    joined = rope.EMPTY
    for part in order:
        joined = rope.concat(joined, part)
    return whole.units, form, prefix.chars, middle.chars, rope.text_of(joined)


def restore(output: str, form: str) -> str:
    """The text that ``transform`` rearranged, from its output and form alone."""
    if form == PLAIN:
        return output
    parts, rest, gone = {}, rope.build(output), 0
    marks = (SUFFIX, PREFIX, MIDDLE) if form == SPM else (PREFIX, SUFFIX, MIDDLE)
    for mark, following in zip(marks, (*marks[1:], None), strict=True):
        _, rest = rope.split_chars(rest, len(mark))
        gone += len(mark)
        end = len(output) if following is None else output.index(following, gone)
        parts[mark], rest = rope.split_chars(rest, end - gone)
        gone = end
    return rope.text_of(rope.concat(rope.concat(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, restored`` of each row of ``docs`` (doc_id, text).

    A null text is empty, and empty texts and such that hold a sentinel stay plain, with null
    prefix_chars and middle_chars.  A null doc_id draws as empty text does.  Rows that repeat
    give rows that repeat, an empty table gives none, and other columns are not read.  Texts
    are worked on whole; one without white space is one unit.  Nothing is shuffled.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [transform(x or "", draws(seed, i), rate, spm_rate) for i, x in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                units, forms, prefix, middle, output = zip(*made, strict=True)
                cols = (pa.array(units, pa.int64()), pa.array(forms), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string()))
                restored = pa.array([restore(o, f) for o, f in zip(output, forms, strict=True)], pa.string())
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols, restored], names=names)

    schema = f"doc_id {key}, n long, form string, prefix_chars long, middle_chars long, output string, restored string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(give_back(run), schema)
