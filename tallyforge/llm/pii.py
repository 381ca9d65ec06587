"""Personal data, in DataFrame functions only.

Fixed patterns find spans that always stand.  Beside them, looser patterns propose spans, and
labelers vote on all of them: the patterns' own checks, gazetteers, the words before, and the
characters around.  Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is, and the posteriors train the final span classifier (naive Bayes over
features of a span), which admits proposed spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.storage import Scratch

KINDS = ["email", "ip", "card", "phone"]
# The fixed patterns.  A match of the first two can begin only where a run of its first class
# does (or the last match ended), which keeps long runs linear; possessive repeats match the
# same, as what follows them cannot match what they took.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An address part of at most 255.
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Looser patterns of proposed spans.
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?"
LOCAL = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"
NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOOSE = f"{NAME}|{LOCAL}|{NUMBER}"
HIDDEN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]+ ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,}"

# Gazetteers: top-level domains, calling codes, first digits of cards, first names.
DOMAINS = "com|org|net|edu|gov|io|co|uk|de|fr|es|eu|info|ch|at|it|nl|us|ca"
CODES = "1|33|34|41|43|44|49|31|39|52|54|55|61|81|86|91"
NAMES = "Anna|Maria|John|James|Robert|Michael|William|David|Mary|Patricia|Jennifer|Linda|Peter|Hans|Klaus|Jean|Pierre|Marie|Luis|Carlos|Jose|Ana|Sarah|Thomas|Paul|Laura"
#: Words before a span that speak for it, and against it.
FOR = r"(?i)(?:e-?mail|contact|phone|tel|call|mobile|card|visa|address|name|reach|dear|signed|ssn|ip)\W*$"
AGAINST = r"(?i)(?:version|isbn|page|figure|section|id|order|no)\W*$"
BEFORE = 24
ROUNDS, ADMIT = 25, 0.8
LABELERS = 4
#: The prior that a proposed span is one, and bounds of what may be learned of it: a kind whose
#: labelers only ever agree must not end up beyond doubt.
PRIOR, LEAST_PRIOR, MOST_PRIOR = 0.7, 0.01, 0.75


#: Elements that ``scan`` takes at a time, and how often it does so; above, it is quadratic in what is left.
CHUNK, LEVELS = 64, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body and its lambdas name it."""
    return F.transform(F.array(value), body)[0]


def scan(x: Column, zero: int, op: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each element of an array of ints what ``op``, which is associative, makes of all before it.

    Chunks are scanned one by one, and their totals likewise, so the work is linear in the array.
    """

    def whole(xs: Column) -> Column:
        grown = F.aggregate(xs, F.array(F.lit(zero)), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v))))
        return F.slice(grown, 1, F.size(xs))

    if not levels:
        return whole(x)

    def cut(xs: Column) -> Column:
        last = F.greatest(F.floor((F.size(xs) - 1) / F.lit(CHUNK)), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(xs, k * CHUNK + 1, F.lit(CHUNK)))

    def join(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(zero), op))
        return F.flatten(F.zip_with(chunks, scan(totals, zero, op, levels - 1), lambda c, s: F.transform(whole(c), lambda v: op(s, v))))

    return let(x, lambda xs: let(cut(xs), join))


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Matches with code-point places, from what lies between them: kind, start, end, hit, before, after."""

    def placed(between: Column, found: Column) -> Column:
        sizes = F.transform(found, lambda hit, i: F.length(F.get(between, i)) + F.length(hit))

        def rows(at: Column) -> Column:
            def row(hit: Column, i: Column) -> Column:
                start = F.get(at, i) + F.length(F.get(between, i))
                before = F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(between, i)), F.lit(BEFORE))
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"), before.alias("before"), F.left(F.get(between, i + 1), F.lit(1)).alias("after"))

            return F.transform(found, row)

        return let(scan(sizes, 0, lambda a, b: a + b), rows)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda found: F.when(F.size(found) == 0, F.array().cast(_FOUND)).otherwise(let(F.split(text, pattern, -1), lambda between: placed(between, found))))


_FOUND = "array<struct<kind:string,start:int,end:int,hit:string,before:string,after:string>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _passes(s: Column, digits: Column) -> Column:
    """The fixed patterns' own checks; null for proposed kinds."""
    size = F.length(digits)
    return (
        F.when(s["kind"] == "email", F.lit(True))
        .when(s["kind"] == "ip", s["hit"].rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"))
        .when(s["kind"] == "card", F.when((size >= 14) & (size <= 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(s["kind"] == "phone", (size >= 10) & (size <= 15))
    )


def _listed(kind: Column, hit: Column) -> Column:
    """What the gazetteers say; null where there is none for a kind."""
    return (
        F.when(kind == "email", hit.rlike(rf"(?i)\.(?:{DOMAINS})$"))
        .when(kind == "hidden_email", hit.rlike(rf"(?i)(?:{DOMAINS})$"))
        .when(kind == "phone", hit.rlike(rf"^\+(?:{CODES})"))
        .when(kind == "card", hit.rlike("^[3-6]"))
        .when(kind == "ip", ~hit.rlike(r"^0*(?:0|127|255)\."))
        .when(kind == "name", hit.rlike(rf" (?:{NAMES})(?: |$)"))
    )


def _vote(s: Column) -> Column:
    """Kind, place, whether it is a base span, the labelers' votes and the classifier's features of a match."""
    kind = (
        F.when(s["kind"] == "hidden", F.lit("hidden_email"))
        .when(s["kind"] != "loose", s["kind"])
        .when(s["hit"].rlike("^[A-Z]"), F.lit("name"))
        .when(s["hit"].rlike("^[0-9]{3}-[0-9]{2}-"), F.lit("number"))
        .otherwise(F.lit("local_phone"))
    )
    sign = lambda c: F.when(c, 1).when(~c, -1).otherwise(0)
    near = lambda c, pattern: F.when(c.rlike(pattern("[A-Za-z0-9]")), "word").when(c.rlike(pattern(r"\s")), "blank").otherwise("mark")

    def judged(k: Column) -> Column:
        context = F.when(s["before"].rlike(FOR), 1).when(s["before"].rlike(AGAINST), -1).otherwise(0)
        return F.struct(
            k["kind"].alias("kind"), F.length(k["digits"]).alias("n"), _passes(s, k["digits"]).alias("passes"), sign(_listed(k["kind"], s["hit"])).alias("listed"), context.alias("context"),
            near(s["before"], lambda c: f"{c}$").alias("before"), near(s["after"], lambda c: f"^{c}").alias("after"),
        )

    def row(j: Column) -> Column:
        glued = (j["before"] == "word") | (j["after"] == "word")
        return F.struct(
            j["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(j["passes"], F.lit(False)).alias("base"),
            F.array(sign(j["passes"]), j["listed"], j["context"], F.when(glued, -1).otherwise(0)).alias("v"),
            F.array(
                F.concat(F.lit("kind:"), j["kind"]), F.concat(F.lit("size:"), F.least(j["n"], F.lit(20)).cast("string")),
                F.concat(F.lit("before:"), j["before"]), F.concat(F.lit("after:"), j["after"]),
                F.concat(F.lit("told:"), j["kind"], F.lit("/"), j["context"].cast("string")), F.concat(F.lit("listed:"), j["kind"], F.lit("/"), j["listed"].cast("string")),
            ).alias("f"),
        )

    return let(F.struct(kind.alias("kind"), _digits(s["hit"]).alias("digits")), lambda k: let(judged(k), row))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, cands``: every match of a fixed or looser pattern, with votes and features.

    The words before a match go back to the start of the match before it, of the same pattern.
    """
    text = F.col("text")
    digit = text.rlike("[0-9]")
    # texts without the character that a pattern needs are not searched
    needs = {
        "email": (EMAIL, F.contains(text, F.lit("@"))), "ip": (IP, F.contains(text, F.lit(".")) & digit), "card": (CARD, digit),
        "phone": (PHONE, F.contains(text, F.lit("+"))), "loose": (LOOSE, F.lit(True)), "hidden": (HIDDEN, text.rlike(r"[\[(]at[\])]")),
    }
    docs = docs.select("doc_id", F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    found = [F.when(need, _found(text, pattern, kind)).otherwise(F.array().cast(_FOUND)) for kind, (pattern, need) in needs.items()]
    return docs.select("doc_id", F.transform(F.concat(*found), _vote).alias("cands"))


#: Expectation-maximisation in one expression over ``pats``: array<struct<v: array<int>, n: bigint>>.
EM = f"""aggregate(sequence(1, {ROUNDS}), named_struct('pi', {PRIOR}D, 'a', array({", ".join(["0.8D"] * LABELERS)})), (st, i) ->
  transform(array(transform(pats, p -> named_struct('v', p.v, 'n', p.n, 'q', 1 / (1 + exp(-(ln(st.pi / (1 - st.pi)) +
      aggregate(sequence(0, {LABELERS - 1}), 0D, (s, j) -> s + p.v[j] * ln(st.a[j] / (1 - st.a[j]))))))))), qs -> named_struct(
    'pi', least({MOST_PRIOR}D, greatest({LEAST_PRIOR}D, aggregate(qs, 0D, (s, p) -> s + p.n * p.q) / aggregate(qs, 0D, (s, p) -> s + p.n))),
    'a', transform(sequence(0, {LABELERS - 1}), j -> least(0.99D, greatest(0.55D,
      aggregate(qs, 8D, (s, p) -> s + p.n * (case p.v[j] when 1 then p.q when -1 then 1 - p.q else 0D end)) /
      aggregate(qs, 10D, (s, p) -> s + p.n * abs(p.v[j])))))))[0])"""


def reliabilities(cands: DataFrame) -> DataFrame:
    """Per kind: prior ``pi`` and each labeler's reliability ``a``, from counts of vote patterns (at most 3 ** 4 a kind)."""
    counts = cands.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.v").agg(F.count("*").alias("n"))
    per = counts.groupBy("kind").agg(F.collect_list(F.struct("v", "n")).alias("pats"))
    return per.select("kind", F.expr(EM).alias("em")).select("kind", "em.pi", "em.a")


def train(cands: DataFrame) -> dict[str, float]:
    """Log odds of the span classifier by feature; "" has the prior's.

    The driver reads one row for each kind and one for each feature value: both lists are fixed.
    """
    em = {r.kind: (r.pi, list(r.a)) for r in reliabilities(cands).collect()}
    if not em:
        return {"": -20.0}
    c = F.col("c")
    logit = F.lit(0.0)
    for kind, (pi, a) in sorted(em.items()):
        value = F.lit(math.log(pi / (1 - pi)))
        for j, x in enumerate(a):
            value = value + c["v"][j] * F.lit(math.log(x / (1 - x)))
        logit = F.when(c["kind"] == kind, value).otherwise(logit)
    spans = cands.select(F.explode("cands").alias("c")).select((1 / (1 + F.exp(-logit))).alias("q"), c["f"].alias("f"))
    spans = spans.select("q", F.explode(F.concat("f", F.array(F.lit("")))).alias("f"))
    sums = {r.f: (r.yes, r.no) for r in spans.groupBy("f").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).collect()}
    yes, no = sums.pop("")
    out = {"": math.log((yes + 1) / (no + 1))}
    return out | {f: math.log((y + 1) / (yes + 2)) - math.log((n + 1) / (no + 2)) for f, (y, n) in sums.items()}


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of each row of ``docs``: base spans and, marked ``base = false``, admitted ones.

    Starts and ends count code points, ends exclusive.  Null or empty text has no spans; rows
    that repeat stay; other columns are not read; an empty table gives no rows.
    """
    keep = Scratch(docs.sparkSession, "pii")
    cands = keep.table(candidates(docs), "candidates")
    odds = train(cands)
    table = F.create_map(*[F.lit(x) for k, v in sorted(odds.items()) for x in (k, float(v))])

    def sure(s: Column) -> Column:
        score = F.aggregate(s["f"], F.lit(odds[""]), lambda acc, f: acc + F.coalesce(F.element_at(table, f), F.lit(0.0)))
        return 1 / (1 + F.exp(-score))

    # the fixed patterns' failing matches are no spans, whatever the classifier says
    stay = F.filter("cands", lambda s: s["base"] | (~s["kind"].isin(*KINDS) & (sure(s) >= ADMIT)))
    flat = F.array_sort(F.transform(stay, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"))))
    return cands.select("doc_id", let(flat, _clear).alias("spans"))


def _clear(spans: Column) -> Column:
    """Of spans in order, the base ones and those that touch no base span."""
    far = 2**31 - 1
    ends = F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(F.lit(-1)))
    starts = F.transform(spans, lambda s: F.when(s["base"], s["start"]).otherwise(F.lit(far)))

    def keep(end: Column, start: Column) -> Column:
        clear = lambda s, i: s["base"] | ((F.get(end, i) <= s["start"]) & (F.get(start, i) >= s["end"]))
        shown = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
        return F.filter(shown, clear)

    before = scan(ends, -1, lambda a, b: F.greatest(a, b))
    after = F.reverse(scan(F.reverse(starts), far, lambda a, b: F.least(a, b)))
    return let(before, lambda end: let(after, lambda start: keep(end, start)))
