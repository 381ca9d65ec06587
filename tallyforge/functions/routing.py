"""Signals of an initial answer, their features, and the transparent router's decision."""

from __future__ import annotations

from typing import Any

from tallyforge.functions.outputs import output_issues

# The features of a router, in order; fixed names.  None may be made from gold.
FEATURES = (
    "task_grounded_qa", "task_structured_extraction", "task_business_summarization", "task_robustness", "difficulty_easy", "difficulty_medium", "difficulty_hard",
    "input_length", "source_evidence_length", "output_length", "initial_confidence", "schema_valid", "parser_success", "citations_present", "citation_count",
    "citation_coverage", "abstain_flag", "validator_failures", "sample_disagreement", "model_is_weak_or_cheap",
)
FORBIDDEN = ("gold", "score", "task_score", "quality")
CRITIC_FROM, DEBATE_FROM = 0.45, 0.75
TASKS, DIFFICULTIES = ("grounded_qa", "structured_extraction", "business_summarization", "robustness"), {"easy": ("easy",), "medium": ("medium",), "hard": ("hard", "high")}


def check_names(names: tuple[str, ...] = FEATURES) -> None:
    """Raise for names that tell of gold."""
    told = [n for n in names if any(word in n.lower() for word in FORBIDDEN)]
    if told:
        raise ValueError(f"features made from gold: {told}")


def features(task: str, given: dict, gold: dict, meta: dict, output: dict, confidence: float, model: str, disagreement: float = 0.0) -> dict[str, float]:
    """The features of an initial output; ``gold`` only brings the schema that the output must have."""
    cited, units = output.get("citations", []), given.get("evidence_units", [])
    n_cited, n_units = (len(x) if isinstance(x, list) else 0 for x in (cited, units))
    found, difficulty = output_issues(task, gold, output), str(meta.get("difficulty", "unknown"))
    coverage = min(1.0, n_cited / n_units) if n_units else float(n_cited > 0)
    values: list[Any] = [
        *[task == t for t in TASKS], *[difficulty in names for names in DIFFICULTIES.values()], len(str(given)), len(str(given.get("source_text", ""))), len(str(output)), confidence,
        not found, not output.get("_parse_error"), n_cited > 0, n_cited, coverage, bool(output.get("abstain", False)), len(found), disagreement, "weak" in model or "cheap" in model,
    ]
    return dict(zip(FEATURES, map(float, values), strict=True))



def uncertainty(f: dict[str, float]) -> float:
    """0 to 1: what speaks against accepting an initial output."""
    parts = (
        0.30 * (not f["parser_success"]), 0.35 * (not f["schema_valid"]), 0.25 * bool(f["task_grounded_qa"] and not f["citation_count"]), 0.20 * (1 - f["citation_coverage"]),
        0.30 * (1 - f["initial_confidence"]), 0.10 * bool(f["abstain_flag"] and f["initial_confidence"] < 0.7), 0.10 * (f["input_length"] > 2000), 0.15 * f["difficulty_hard"],
        0.10 * min(3, f["validator_failures"]), 0.30 * f["sample_disagreement"],
    )
    return min(1.0, sum(parts))


def route(score: float, critic: float = CRITIC_FROM, debate: float = DEBATE_FROM) -> str:
    return "debate" if score >= debate else "critic" if score >= critic else "accept"


