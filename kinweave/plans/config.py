"""Declarative configuration: sources, rules, exclusions, fuzzy rules, survivorship."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

STRATEGIES = {
    "RECENCY": "RECENCY", "MOST_RECENT": "RECENCY", "PRIORITY": "PRIORITY", "SOURCE_PRIORITY": "PRIORITY", "FREQUENCY": "FREQUENCY", "MOST_FREQUENT": "FREQUENCY",
    "FIRST_SEEN": "FIRST_SEEN", "AGG_MAX": "AGG_MAX", "AGG_SUM": "AGG_SUM",
}
CANONICAL = {"LOWERCASE", "UPPERCASE", "NONE", "EXACT", "", "TRIM", "DIGITS_ONLY"}
DEFAULT_CAP = 10_000
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_TABLE = re.compile(r"[A-Za-z_][A-Za-z0-9_$-]*(\.[A-Za-z_][A-Za-z0-9_$-]*){0,2}")
_FORBIDDEN = re.compile(r"(;|--|/\*|\*/)|\b(insert|update|delete|drop|alter|create|truncate|grant|revoke|merge|exec|execute|union)\b", re.I)


class ConfigError(ValueError):
    """A configuration that cannot be run."""


def check_name(value: str, what: str) -> str:
    if not isinstance(value, str) or not _NAME.fullmatch(value):
        raise ConfigError(f"{what}: {value!r} is not an identifier")
    return value


def check_table(value: str) -> str:
    if not isinstance(value, str) or not _TABLE.fullmatch(value):
        raise ConfigError(f"{value!r} is not a table name of one to three parts")
    return value


def check_expression(value: str, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f"{what}: empty expression")
    if m := _FORBIDDEN.search(re.sub(r"'(?:[^']|'')*'", "''", value)):
        raise ConfigError(f"{what}: {m.group(0)!r} is not allowed in an expression")
    return value


def check_number(value: Any, what: str, whole: bool = False) -> float | int:
    try:
        number = int(value) if whole else float(value)
    except (TypeError, ValueError):
        raise ConfigError(f"{what}: {value!r} is not a number") from None
    if abs(number) >= 1e15 or number != number or (whole and number != float(value)):
        raise ConfigError(f"{what}: {value!r} is out of range")
    return number


@dataclass(frozen=True)
class Source:
    table_id: str
    table: str
    key: str = "id"
    identifiers: tuple[tuple[str, str], ...] = ()
    attributes: tuple[tuple[str, str], ...] = ()
    watermark: str | None = None
    lookback_minutes: int = 0
    entity_type: str = "PERSON"
    active: bool = True
    trust_rank: int | None = None
    hashed: tuple[str, ...] = ()
    format: str | None = None


@dataclass(frozen=True)
class Rule:
    identifier_type: str
    canonicalize: str = "LOWERCASE"
    max_group_size: int | None = DEFAULT_CAP  # None: groups of any size are joined
    priority: int = 1
    active: bool = True
    require_non_null: bool = True
    rule_id: str = ""

    @property
    def name(self) -> str:
        return self.rule_id or f"exact_{self.identifier_type}"


@dataclass(frozen=True)
class FuzzyRule:
    name: str
    blocking: str
    score: str
    threshold: float
    priority: int = 1
    active: bool = True
    rule_id: str = ""


@dataclass(frozen=True)
class Exclusion:
    identifier_type: str
    pattern: str
    match: str = "EXACT"
    reason: str = ""


@dataclass(frozen=True)
class Survivorship:
    attribute: str
    strategy: str = "RECENCY"
    priority: tuple[str, ...] = ()
    recency_field: str | None = None
    active: bool = True


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...]
    rules: tuple[Rule, ...]
    exclusions: tuple[Exclusion, ...] = ()
    fuzzy: tuple[FuzzyRule, ...] = ()
    survivorship: tuple[Survivorship, ...] = ()
    evidence: bool = True
    max_rounds: int = 30
    block_cap: int = DEFAULT_CAP
    options: dict = field(default_factory=dict, hash=False, compare=False)

    def active_sources(self) -> list[Source]:
        return [s for s in self.sources if s.active]

    def survivorship_rules(self) -> tuple[Survivorship, ...]:
        """Active rules; one by priority without a list takes the sources in order of their trust rank (1 first, none last)."""
        ranked = tuple(s.table_id for s in sorted((s for s in self.sources if s.trust_rank is not None), key=lambda s: (s.trust_rank, s.table_id)))
        return tuple(replace(r, priority=ranked) if STRATEGIES[r.strategy] == "PRIORITY" and not r.priority else r for r in self.survivorship if r.active)

    def rule_of(self) -> dict[str, Rule]:
        return {r.identifier_type: r for r in self.rules if r.active}

    def to_dict(self) -> dict:
        return {f.name: ([asdict(x) for x in getattr(self, f.name)] if isinstance(getattr(self, f.name), tuple) else getattr(self, f.name)) for f in fields(self) if f.name != "options"}

    def fingerprint(self) -> str:
        """First 16 hex digits of the SHA-256 of the sorted configuration."""
        own = self.to_dict()
        for key in ("sources", "rules", "exclusions", "fuzzy", "survivorship"):
            own[key] = sorted(own[key], key=lambda x: json.dumps(x, sort_keys=True))
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()[:16]


def _pairs(value: Any, name: str, expression: str) -> tuple[tuple[str, str], ...]:
    """Accept {name: expression}, [{name:…, expression:…}], [{name: expression}] and [[name, expression]]."""
    if not value:
        return ()
    if isinstance(value, dict):
        return tuple((k, v["expr"] if isinstance(v, dict) else v) for k, v in value.items())
    out = []
    for item in value:
        if isinstance(item, (list, tuple)):
            out.append((item[0], item[1]))
        elif name in item or "type" in item or "name" in item:
            out.append((item.get(name) or item.get("type") or item.get("name"), item.get(expression) or item.get("expr") or item.get("column") or item.get("column_expr")))
        else:
            out.extend(item.items())
    return tuple((str(a), str(b)) for a, b in out)


def _per_dialect(value: Any) -> str:
    if isinstance(value, dict):
        for key in ("spark", "default", "databricks"):
            if key in value:
                return value[key]
        raise ConfigError(f"no expression for Spark among {sorted(value)}")
    return value


def _words(value: Any) -> tuple[str, ...]:
    """A list, a JSON list, a list written with single quotes, or a comma list."""
    if not value:
        return ()
    if isinstance(value, (list, tuple)):
        return tuple(map(str, value))
    text = str(value).strip()
    if text.startswith("["):
        for attempt in (text, text.replace("'", '"')):
            try:
                return tuple(map(str, json.loads(attempt)))
            except json.JSONDecodeError:
                continue
    return tuple(x.strip() for x in text.strip("[]").split(",") if x.strip())


def from_dict(raw: dict) -> Config:
    """Build and validate a configuration from its YAML shape; both spellings of every older key are taken."""
    if not isinstance(raw, dict):
        raise ConfigError("the configuration is not a mapping")
    settings = raw.get("settings") or {}
    rules_raw = raw.get("rules") or []
    if not raw.get("sources"):
        raise ConfigError("no sources")
    if not rules_raw:
        raise ConfigError("no rules")
    rules, fuzzy = [], []
    for k, r in enumerate(rules_raw):
        kind = str(r.get("type") or r.get("rule_type") or ("FUZZY" if r.get("score") or r.get("score_expr") else "EXACT")).upper()
        (fuzzy if kind == "FUZZY" else rules).append((k, r))
    fuzzy += [(len(rules_raw) + k, r) for k, r in enumerate(raw.get("fuzzy_rules") or raw.get("fuzzy") or [])]
    exact = []
    for k, r in rules:
        types = r.get("identifiers") or r.get("match_keys") or [r.get("identifier_type") or r.get("identifier") or r.get("match_on") or r.get("name") or r.get("rule_id")]
        for t in types if isinstance(types, (list, tuple)) else [types]:
            canon = str(r.get("canonicalize", "LOWERCASE") or "").upper()
            if canon not in CANONICAL:
                raise ConfigError(f"rule {t}: unknown canonicalize {canon}")
            exact.append(Rule(str(t), canon, int(check_number(r.get("max_group_size", DEFAULT_CAP), f"rule {t}", True)), int(r.get("priority", k + 1)), bool(r.get("is_active", r.get("active", True))), bool(r.get("require_non_null", True)), str(r.get("rule_id") or "")))
    found_fuzzy = tuple(
        FuzzyRule(str(r.get("name") or r.get("rule_name") or f"fuzzy_{k}"), check_expression(_per_dialect(r.get("blocking_key") or r.get("blocking_key_expr") or r.get("blocking")), "blocking key"),
                  check_expression(_per_dialect(r.get("score") or r.get("score_expr")), "score"), float(check_number(r.get("threshold", 0.85), "threshold")), int(r.get("priority", k + 1)), bool(r.get("is_active", r.get("active", True))), str(r.get("rule_id") or ""))
        for k, r in fuzzy
    )
    sources = []
    for s in raw["sources"]:
        table_id = check_name(str(s.get("id") or s.get("table_id") or s.get("name")), "source")
        ids = _pairs(s.get("identifiers"), "identifier_type", "identifier_value_expr") or tuple((r.identifier_type, r.identifier_type.lower()) for r in exact)
        attrs = _pairs(s.get("attributes"), "attribute_name", "attribute_expr")
        for name, expression in ids + attrs:
            check_expression(expression, f"{table_id}.{name}")
        sources.append(Source(
            table_id, check_table(str(s.get("table") or s.get("table_fqn") or table_id)), check_expression(str(s.get("entity_key") or s.get("entity_key_expr") or s.get("key") or "id"), "key"), ids, attrs,
            s.get("watermark_column") or s.get("watermark"), int(check_number(s.get("watermark_lookback_minutes", s.get("watermark_lookback", s.get("lookback_minutes", 0))) or 0, "lookback", True)),
            str(s.get("entity_type", "PERSON")), bool(s.get("is_active", s.get("active", True))), None if s.get("trust_rank") is None else int(check_number(s["trust_rank"], "trust rank", True)), _words(s.get("hashed")), s.get("format"),
        ))
    exclusions = tuple(Exclusion(str(x.get("identifier_type") or x.get("type")), str(x.get("pattern") or x.get("identifier_value_pattern") or x.get("value")), str(x.get("match_type") or x.get("match") or "EXACT").upper(), str(x.get("reason") or "")) for x in raw.get("exclusions") or [])
    for x in exclusions:
        if x.match not in ("EXACT", "LIKE"):
            raise ConfigError(f"exclusion: unknown match {x.match}")
    keep = raw.get("survivorship") or []
    if isinstance(keep, dict):
        keep = [{"attribute": k, **(v if isinstance(v, dict) else {"strategy": v})} for k, v in keep.items()]
    survivorship = []
    for r in keep:
        strategy = str(r.get("strategy", "RECENCY")).upper()
        if strategy not in STRATEGIES:
            raise ConfigError(f"survivorship: unknown strategy {strategy}")
        survivorship.append(Survivorship(check_name(str(r.get("attribute") or r.get("attribute_name")), "attribute"), STRATEGIES[strategy], _words(r.get("source_priority") or r.get("source_priority_list") or r.get("priority") or r.get("order")), r.get("recency_field"), bool(r.get("is_active", True))))
    evidence = raw.get("generate_evidence", settings.get("generate_evidence", raw.get("evidence", True)))
    if not isinstance(evidence, bool):
        raise ConfigError("generate_evidence is not a boolean")
    names = [s.table_id for s in sources]
    if len(set(names)) != len(names):
        raise ConfigError("a source id occurs twice")
    return Config(tuple(sources), tuple(exact), exclusions, found_fuzzy, tuple(survivorship), evidence, int(settings.get("max_iterations", raw.get("max_rounds", 30))), int(settings.get("block_cap", raw.get("block_cap", DEFAULT_CAP))), settings)


def load(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {})


def resolve_attribute(attributes: dict[str, str], name: str, fallbacks: tuple[str, ...], columns: list[str]) -> str | None:
    """The mapped expression of an attribute, else the first fallback column that exists."""
    if name in attributes:
        return attributes[name]
    have = {c.lower(): c for c in columns}
    return next((have[c.lower()] for c in (name, *fallbacks) if c.lower() in have), None)
