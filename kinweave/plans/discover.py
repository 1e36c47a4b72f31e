"""A configuration to start from: a template, or a guess from the columns of tables."""

from __future__ import annotations

import yaml

#: Identifier types by what a column's name holds, in the order in which they are tried.
HINTS = (("email", "EMAIL", "LOWERCASE"), ("mail", "EMAIL", "LOWERCASE"), ("phone", "PHONE", "DIGITS_ONLY"), ("mobile", "PHONE", "DIGITS_ONLY"), ("loyalty", "LOYALTY_ID", "NONE"), ("customer_id", "CUSTOMER_ID", "NONE"), ("custkey", "CUSTOMER_ID", "NONE"))
ATTRIBUTES = ("first_name", "last_name", "name", "city", "country")
WATERMARKS = ("updated_at", "modified_at", "created_at", "ts")


def guessed(tables: dict[str, list[str]]) -> str:
    """YAML for tables by their columns: the first column ending in id or key names the entity."""
    sources, rules = [], {}
    for name, columns in tables.items():
        low = {c.lower(): c for c in columns}
        key = next((c for c in columns if c.lower().endswith(("id", "key"))), columns[0])
        ids = {}
        for c in columns:
            hint = next(((t, how) for part, t, how in HINTS if part in c.lower()), None)
            if hint and hint[0] not in ids:
                ids[hint[0]] = c
                rules[hint[0]] = hint[1]
        source = {"id": name, "table": name, "entity_key": key, "identifiers": ids, "attributes": {a: low[a] for a in ATTRIBUTES if a in low}}
        mark = next((low[w] for w in WATERMARKS if w in low), None)
        sources.append(source | ({"watermark_column": mark} if mark else {}))
    return yaml.safe_dump({"sources": sources, "rules": [{"identifier_type": t, "canonicalize": how, "priority": k} for k, (t, how) in enumerate(rules.items(), 1)]}, sort_keys=False)


def template() -> str:
    return guessed({"customers": ["customer_id", "email", "phone", "first_name", "last_name", "updated_at"], "orders": ["order_id", "customer_id", "email", "created_at"]})
