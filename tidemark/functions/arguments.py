"""Driver-side argument handling and small reports; no data operator."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame


def choices(text: str, allowed: Sequence[str]) -> list[str]:
    """The comma-separated names in ``text``, each once, in order; an unknown name or an empty list raises."""
    names = list(dict.fromkeys(x for part in text.split(",") if (x := part.strip())))
    if unknown := set(names) - set(allowed):
        raise ValueError(f"unknown: {sorted(unknown)}; known: {list(allowed)}")
    if not names:
        raise ValueError("an empty list")
    return names


def fold_options(args: Iterable[str], with_value: Sequence[str]) -> list[str]:
    """Options given more than once are given once: at their first place, with their last value. Other arguments stay."""
    folded: dict[object, list[str]] = {}
    rest = iter(args)
    for k, a in enumerate(rest):
        if a in with_value:
            try:
                folded[a] = [a, next(rest)]
            except StopIteration:
                raise ValueError(f"{a} has no value") from None
        elif a.startswith("--"):
            folded[a] = [a]
        else:
            folded[k] = [a]
    return [x for part in folded.values() for x in part]


def command_tokens(options: Mapping[str, object]) -> list[str]:
    """``--some-name value`` tokens; true is a flag alone, false and null give nothing, lists are comma-separated."""
    out = []
    for name, value in options.items():
        if value is None or value is False:
            continue
        out.append("--" + name.replace("_", "-"))
        if value is not True:
            out.append(",".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value))
    return out


def yaml_text(value: object, depth: int = 0) -> str:
    """Mappings, lists and scalars as YAML; strings are quoted."""
    import json

    pad = "  " * depth
    if isinstance(value, Mapping) and value:
        return "".join(f"{pad}{k}:" + (f"\n{yaml_text(v, depth + 1)}" if isinstance(v, (Mapping, list, tuple)) and v else f" {yaml_text(v)}\n") for k, v in value.items())
    if isinstance(value, (list, tuple)) and value:
        return "".join(f"{pad}- {yaml_text(v, depth + 1).strip()}\n" for v in value)
    return json.dumps(value, ensure_ascii=False)


def markdown(df: DataFrame, rows: int = 100) -> str:
    """A table of the first ``rows`` rows, which is the report's length; null is a dash, floats have four decimals."""
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in df.limit(rows).collect()]]
    return "".join("| " + " | ".join(x) + " |\n" for x in lines)
