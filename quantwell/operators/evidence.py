"""Evidence over results of at most a hundred rows: exact arithmetic on the driver."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from decimal import Decimal

from quantwell.plans.errors import QueryError


def calculate(operation: str, left: Decimal | None, right: Decimal | None, *, subset: bool = False) -> Decimal | None:
    """difference, ratio, or share of a proven subset; null if an operand is unknown or can't divide."""
    if left is None or right is None:
        return None
    if operation == "difference":
        return left - right
    if operation == "ratio":
        return left / right if right else None
    if operation == "share":
        if not subset or not 0 <= left <= right or right <= 0:
            raise QueryError("CALCULATION_SCOPE_INCOMPATIBLE", "a share needs a part of a positive whole", "calculations")
        return left / right
    raise QueryError("CALCULATION_OPERATION_UNSUPPORTED", operation, "calculations")


def ranking(values: list[Decimal | None], complete: bool) -> dict[str, object]:
    """Whether a unique largest value is proven, and how many share it or are unknown."""
    known = [v for v in values if v is not None]
    top = max(known, default=None)
    ties = sum(v == top for v in known)
    return {"top": top, "tie_count": ties, "unknown_count": len(values) - len(known), "unique_top_proven": bool(known) and ties == 1 and complete and len(known) == len(values)}


def period_summary(months: Mapping[str, Decimal | None], selected: list[str], complete: set[str], additive: bool) -> dict[str, object]:
    """Selected months against the whole window: a ratio of sums on complete months of an additive value."""
    if not additive:
        raise QueryError("NONADDITIVE_PERIOD_FIELD", "this value does not add up over periods")
    whole = {m: v for m, v in months.items() if m in complete}
    chosen = [whole.get(m) for m in selected]
    if not whole or any(v is None for v in [*whole.values(), *chosen]):
        return {"selected_sum": None, "window_sum": None, "ratio": None}
    a, b = sum(chosen, Decimal(0)), sum(whole.values(), Decimal(0))
    return {"selected_sum": a, "window_sum": b, "ratio": a / b if b > 0 else None}


def fingerprint(document: object) -> str:
    """sha256 over canonical JSON."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), default=str, ensure_ascii=False).encode()).hexdigest()


def report_gate(packets: list[Mapping[str, object]]) -> list[str]:
    """What keeps a report back: failed, truncated or incomplete packets. Empty if it may go out."""
    out = []
    for k, p in enumerate(packets):
        if p.get("error"):
            out.append(f"{k}: {p['error']}")
        elif p.get("truncated"):
            out.append(f"{k}: truncated")
        elif p.get("data_state") in ("incomplete", "undefined"):
            out.append(f"{k}: {p['data_state']}")
    return out


def snapshot_month(rows: Sequence[Mapping[str, object]], column: str = "snapshot_month") -> str | None:
    """The one month (YYYY-MM) that the rows of a snapshot come from; None if they name none, an error if several."""
    months = {str(r[column])[:7] for r in rows if r.get(column) not in (None, "")}
    if len(months) > 1:
        raise QueryError("CONTRACT_UNAVAILABLE", f"rows of one snapshot come from {len(months)} months")
    return months.pop() if months else None


def gap_ratio(gap: Decimal | None, target: Decimal | None, gap_unit: str | None, target_unit: str | None) -> dict[str, object]:
    """gap / target with the state of the value: unit_unverified, missing_input, zero_denominator or available."""
    same = bool(gap_unit) and gap_unit == target_unit
    state = "unit_unverified" if not same else "missing_input" if gap is None or target is None else "zero_denominator" if target == 0 else "available"
    return {"value": gap / target if state == "available" else None, "value_state": state, "unit": gap_unit if same else None}


def coverage_ratio(numerator: int | None, *terms: int | None) -> Decimal | None:
    """numerator / sum of terms, counts of source records; None if one is unknown or nothing is counted."""
    if numerator is None or None in terms or min((numerator, *terms)) < 0 or not sum(terms):
        return None
    return Decimal(numerator) / sum(terms)


def disclosures(rules: Sequence[Mapping[str, object]], facts: Mapping[str, object]) -> list[str]:
    """Texts that an answer must carry: those required always, and those whose condition the facts meet.

    A rule has `text`, `kind` (required_always, required_when, contract_only) and for the second
    `when`: a fact and the values that call for the text. Texts for the contract alone never appear.
    """
    out = []
    for rule in rules:
        kind = rule["kind"]
        if kind not in ("required_always", "required_when", "contract_only"):
            raise QueryError("CONTRACT_UNAVAILABLE", f"no disclosure {kind}")
        if kind == "required_always" or kind == "required_when" and any(facts.get(k) in v for k, v in rule["when"].items()):
            out.append(str(rule["text"]))
    return list(dict.fromkeys(out))


def reconciled(parts: Mapping[str, Sequence[Decimal | None]], wholes: Mapping[str, Decimal | None]) -> list[str]:
    """Names of the measures whose parts don't add up exactly to their whole, or where one is unknown on one side alone."""
    out = []
    for name, whole in wholes.items():
        own = parts.get(name, ())
        known = None not in own
        if known != (whole is not None) or known and sum(own, Decimal(0)) != whole:
            out.append(name)
    return out


def text_report(title: str, columns: Sequence[str], rows: Sequence[Mapping[str, object]], notes: Sequence[str] = ()) -> str:
    """A Markdown report of at most a hundred rows: a heading, a table and notes; unknown values are shown as a dash."""
    cell = lambda v: "–" if v is None else f"{v:,}" if isinstance(v, (int, Decimal)) and not isinstance(v, bool) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]
    return "\n".join([*lines, *([""] if notes else []), *(f"- {n}" for n in notes)]) + "\n"
