"""Rules for changing the event schema: readable in both directions, enum symbols only appended."""

from __future__ import annotations


class SchemaRejected(ValueError):
    """The proposed schema would make written data unreadable or, worse, readable as something else."""


def enums(schema) -> dict[str, list[str]]:
    """Symbols of every enum anywhere in the schema."""
    found: dict[str, list[str]] = {}
    stack = [schema]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            if node.get("type") == "enum":
                found[node["name"]] = node["symbols"]
            stack.extend(node.values())
        elif isinstance(node, list):
            stack.extend(node)
    return found


def enum_order_changes(old: dict, new: dict) -> list[str]:
    """What a reader of one schema would misread in data of the other: old symbols must be a prefix of the new ones."""
    after, out = enums(new), []
    for name, symbols in enums(old).items():
        now = after.get(name)
        if now is None or now[: len(symbols)] == symbols:
            continue
        at = next(i for i in range(len(symbols)) if i >= len(now) or now[i] != symbols[i])
        out.append(f"enum {name}: index {at} was {symbols[at]}, becomes {now[at] if at < len(now) else 'undefined'}")
    return out


def _shape(kind) -> object:
    if isinstance(kind, list):
        return tuple(_shape(k) for k in kind)
    if isinstance(kind, dict):
        return (kind["type"], kind.get("logicalType"))
    return kind


def check_evolution(old: dict, new: dict) -> None:
    """Full compatibility: shared fields keep their types, added and removed fields have defaults."""
    problems = enum_order_changes(old, new)
    before, after = ({f["name"]: f for f in s["fields"]} for s in (old, new))
    for name in before.keys() & after.keys():
        if _shape(before[name]["type"]) != _shape(after[name]["type"]):
            problems.append(f"field {name} changes its type")
    problems += [f"added field {n} has no default" for n in after.keys() - before.keys() if "default" not in after[n]]
    problems += [f"removed field {n} had no default" for n in before.keys() - after.keys() if "default" not in before[n]]
    if problems:
        raise SchemaRejected("; ".join(sorted(problems)))
