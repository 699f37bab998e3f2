"""What a detection run knows: brands, allowlist, terms, enabled rules, digit exceptions, suffix rules.

All of it is configuration that analysts keep, held on the driver. Sets go into the plan as constants up to
a checked size and are joined as tables beyond it; the watchlist's builder makes at most 10,000 brands.
"""

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.functions.psl import SuffixRules, load_rules

#: Families in the order of output, and their rules in the order of evaluation.
FAMILY_RULES = {
    "referential": ("R-01", "R-02", "R-03", "R-04"),
    "lexical": ("L-01", "L-02", "L-03", "L-04"),
    "encoding": ("E-01", "E-02"),
    "morphological": ("M-01", "M-02", "M-03", "M-04"),
}
RULES = tuple(r for rs in FAMILY_RULES.values() for r in rs)
RULE_FAMILY = {r: f for f, rs in FAMILY_RULES.items() for r in rs}

#: Detection terms by rule.
TERMS = {
    "L-01": ("mfa", "2fa", "otp", "token", "passkey", "authenticator", "sso"),
    "L-02": ("invoice", "esign", "signature", "contract", "voicemail", "shared", "pdf"),
    "L-04": ("login", "verify", "secure", "billing", "refund", "suspended", "expired"),
    "R-04": ("login", "signin", "logon", "auth", "verify", "secure", "account", "password", "credentials", "mfa", "sso", "otp"),
}
#: Platform suffixes below which every name is suppressed.
SHARED_HOSTING = ("azure-api.net", "meraki.direct")

SHORTEST_DIGIT_RUN = 3
#: What ``str.strip`` drops.
_BLANK = r"[\s\p{Z}\x{85}\x1c-\x1f]"


@dataclass(frozen=True)
class DetectContext:
    brands: frozenset[str] = frozenset()
    allowlist: frozenset[str] = frozenset()
    digit_exceptions: frozenset[str] = frozenset()
    terms: dict[str, frozenset[str]] = field(default_factory=dict)
    rules: frozenset[str] | None = None
    suffixes: SuffixRules = field(default_factory=load_rules)

    def __post_init__(self) -> None:
        if unknown := (self.rules or frozenset()) - frozenset(RULES):
            raise ValueError(f"unknown rules: {sorted(unknown)}")

    def on(self, rule: str) -> bool:
        return self.rules is None or rule in self.rules

    @property
    def reinforced(self) -> bool:
        """Whether morphological hits need another family: not if only morphological rules are enabled."""
        return self.rules is None or any(RULE_FAMILY[r] != "morphological" for r in self.rules)


def digit_runs(domains: Iterable[str]) -> frozenset[str]:
    """Digit runs of legitimate domains that the digit rule has to leave alone."""
    return frozenset(r for d in domains for r in re.findall(r"\d+", d) if len(r) >= SHORTEST_DIGIT_RUN)


def default_terms() -> dict[str, frozenset[str]]:
    return {r: frozenset(ts) for r, ts in TERMS.items()}


def make_context(entries: Iterable[tuple[str, Iterable[str]]], terms: dict[str, frozenset[str]] | None = None, rules: frozenset[str] | None = None, shared: Iterable[str] = SHARED_HOSTING, suffixes: SuffixRules | None = None) -> DetectContext:
    """From (brand name, legitimate domains): names are trimmed and lowered, domains are taken as written."""
    names, legit = set(), set()
    for name, domains in entries:
        names.add(name)
        legit.update(d for d in domains or () if d is not None)
    return _context(names, legit, terms, rules, shared, suffixes)


def _context(names: Iterable[str], legit: Iterable[str], terms: dict[str, frozenset[str]] | None = None, rules: frozenset[str] | None = None, shared: Iterable[str] = SHARED_HOSTING, suffixes: SuffixRules | None = None) -> DetectContext:
    return DetectContext(
        brands=frozenset(n.strip().lower() for n in names), allowlist=frozenset(legit) | frozenset(shared), digit_exceptions=digit_runs(legit),
        terms=default_terms() if terms is None else terms, rules=rules, suffixes=suffixes or load_rules(),
    )


def context_of_table(watchlist: DataFrame, tiers: Iterable[str] | None = None, **more) -> DetectContext:
    """From a watchlist table (name, tier, legitimate_domains). Names and domains are made distinct before they are read."""
    rows = watchlist.where("name is not null")
    if tiers is not None:
        rows = rows.where(rows.tier.isin(list(tiers)))
    names = _distinct(rows.select(F.lower(F.regexp_replace("name", f"^{_BLANK}+|{_BLANK}+$", "")).alias("x")))
    legit = _distinct(rows.select(F.explode("legitimate_domains").alias("x")).where("x is not null"))
    return _context(names, legit, **more)


def _distinct(values: DataFrame) -> list[str]:
    """The different values of column ``x``, all of them."""
    return [r.x for r in values.distinct().toLocalIterator()]


def _yaml(path: str | Path) -> dict:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def read_watchlist(path: str | Path) -> list[tuple[str, list[str]]]:
    """(name, legitimate domains) of a watchlist file; a missing file is an empty list."""
    if not Path(path).exists():
        return []
    return [(b["name"], b.get("legitimate_domains") or []) for b in _yaml(path).get("brands") or []]


def read_terms(path: str | Path) -> dict[str, frozenset[str]]:
    """Terms by rule id in upper case; terms trimmed and lowered. A missing file means no terms."""
    if not Path(path).exists():
        return {}
    return {k.upper(): frozenset(t.strip().lower() for t in ts) for k, ts in (_yaml(path).get("terms") or {}).items()}


def read_rules(path: str | Path) -> frozenset[str]:
    """Enabled rules: those listed as true; unlisted ones are off, unknown ids an error, a missing file is all."""
    if not Path(path).exists():
        return frozenset(RULES)
    listed = _yaml(path)["rules"]
    if unknown := set(listed) - set(RULES):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    return frozenset(r for r, on in listed.items() if on)


def read_shared_hosting(path: str | Path) -> frozenset[str]:
    if not Path(path).exists():
        return frozenset()
    return frozenset(s.strip().lower() for s in _yaml(path).get("suffixes") or [])
