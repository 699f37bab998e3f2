"""Public Suffix List: rules read from a list file, and name splitting as built-in column expressions.

The list is a parameter. By default it is the system's copy, else the one that ships inside Spark's jars.
Private suffixes count. There is no default rule: a name under an unknown top-level domain has no suffix.
"""

import zipfile
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.functions.text import host_form

SYSTEM_LIST = "/usr/share/publicsuffix/public_suffix_list.dat"
JAR_ENTRY = "mozilla/public-suffix-list.txt"
#: The table of suffix rules and allowlisted names is broadcast; more allowlisted names are joined by shuffle.
MOST_FACTS = 500_000


@dataclass(frozen=True)
class SuffixRules:
    """Rules by their number of labels: plain ones, parents of wildcards (with the wildcard's label counted), exceptions."""

    plain: dict[int, frozenset[str]] = field(default_factory=dict)
    wild: dict[int, frozenset[str]] = field(default_factory=dict)
    exempt: dict[int, frozenset[str]] = field(default_factory=dict)

    @property
    def longest(self) -> int:
        return max([0, *self.plain, *self.wild, *self.exempt])


def parse_rules(text: str) -> SuffixRules:
    """Reads a list in the public format; internationalised rules also count in their ASCII spelling."""
    kinds: tuple[dict, dict, dict] = ({}, {}, {})
    for line in text.splitlines():
        rule = line.split(maxsplit=1)[0].lower() if line.strip() else ""
        if not rule or rule.startswith("//"):
            continue
        kind = 2 if rule[0] == "!" else 1 if rule.startswith("*.") else 0
        body = rule[kind:] if kind < 2 else rule[1:]
        body = body.removeprefix(".")
        for spelling in {body, _ascii(body)}:
            kinds[kind].setdefault(spelling.count(".") + 1 + (kind == 1), set()).add(spelling)
    return SuffixRules(*({n: frozenset(s) for n, s in sorted(k.items())} for k in kinds))


def _ascii(name: str) -> str:
    if name.isascii():
        return name
    try:
        return ".".join(x.encode("idna").decode("ascii") for x in name.split("."))
    except UnicodeError:
        return name


@cache
def load_rules(path: str | None = None) -> SuffixRules:
    if path is None and not Path(SYSTEM_LIST).exists():
        import pyspark

        for jar in sorted(Path(pyspark.__file__).parent.glob("jars/*.jar")):
            with zipfile.ZipFile(jar) as z:
                if JAR_ENTRY in z.namelist():
                    return parse_rules(z.read(JAR_ENTRY).decode("utf-8"))
        raise FileNotFoundError("no public suffix list found; give its path")
    return parse_rules(Path(path or SYSTEM_LIST).read_text(encoding="utf-8"))


def last_labels(name: Column, n: int) -> Column:
    return F.substring_index(name, ".", -n)


def _labels_from(name: Column, n: Column) -> Column:
    """The first ``n`` labels, or the last ones if ``n`` is negative; ``n`` varies by row."""
    return F.call_function("substring_index", name, F.lit("."), n)


#: Bits of a name's facts: it is a rule, a wildcard stands below it, it is an exception, it is allowlisted.
PLAIN, WILD, EXEMPT, ALLOWED = 1, 2, 4, 8


def name_facts(spark: SparkSession, rules: SuffixRules, allowed: frozenset[str] = frozenset()) -> tuple[DataFrame, int]:
    """((name, bits), most labels): all suffix rules and allowlisted names as one small table of checked size."""
    bits: dict[str, int] = {}
    for kind, names in ((PLAIN, rules.plain), (WILD, rules.wild), (EXEMPT, rules.exempt)):
        for group in names.values():
            for name in group:
                bits[name] = bits.get(name, 0) | kind
    for name in allowed:
        bits[name] = bits.get(name, 0) | ALLOWED
    names = sorted(bits)
    rows = pa.table({"name": pa.array(names, pa.string()), "bits": pa.array([bits[n] for n in names], pa.int32())})
    return spark.createDataFrame(rows), max([1, *(n.count(".") + 1 for n in names)])


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def with_fqdn(df: DataFrame, host: str) -> DataFrame:
    """Adds ``fqdn``, the cleaned-up name, and ``n_labels``."""
    fqdn = F.col("fqdn")
    df = df.withColumn("fqdn", host_form(F.col(host)))
    return df.withColumn("n_labels", F.when(fqdn == "", 0).otherwise(F.length(fqdn) - F.length(F.replace(fqdn, F.lit("."), F.lit(""))) + 1))


def with_parts(df: DataFrame, rules: SuffixRules, allowed: frozenset[str] = frozenset()) -> DataFrame:
    """Adds suffix, registrable, subdomain, core and is_allowed to rows with ``fqdn`` and ``n_labels``.

    The last one, two, ... labels of a name, as many as a suffix rule can have, are looked up in the table of
    facts by broadcast hash joins (the table is of checked size), so no row is shuffled and no rule is tested
    one by one. Allowlisted names of more labels, or too many of them, are joined apart. ``core`` is the
    registrable name without its suffix: the one label left of it, or empty.
    """
    fqdn, n = F.col("fqdn"), F.col("n_labels")
    shallow = frozenset(a for a in allowed if a.count(".") < rules.longest) if len(allowed) <= MOST_FACTS else frozenset()
    facts, longest = name_facts(df.sparkSession, rules, shallow)
    at = [F.lit(0)]
    for k in range(1, longest + 1):
        side = F.broadcast(facts.select(F.col("name").alias(f"_name{k}"), F.col("bits").alias(f"_bits{k}")))
        df = df.join(side, F.when(n >= k, last_labels(fqdn, k)) == F.col(f"_name{k}"), "left")
        at.append(F.coalesce(f"_bits{k}", F.lit(0)))
    rule = [F.lit(False)]
    for k in range(1, longest + 2):
        plain = at[k].bitwiseAND(PLAIN) != 0 if k <= longest else F.lit(False)
        rule.append(plain | ((n >= k) & (at[k - 1].bitwiseAND(WILD) != 0)))

    def chosen(exempt, matched, otherwise: Column) -> Column:
        """One value by the winning rule of k labels: an exception first, then the longest rule."""
        out = None
        for k in range(longest, 0, -1):
            test, value = at[k].bitwiseAND(EXEMPT) != 0, exempt(k)
            out = F.when(test, value) if out is None else out.when(test, value)
        for k in range(longest + 1, 0, -1):
            out = out.when(rule[k], matched(k))
        return out.otherwise(otherwise)

    # each part reads the choice once, so that filters on it are pushed down without growing
    size = chosen(lambda k: F.lit(k - 1), lambda k: F.lit(k), F.lit(0))
    taken = chosen(lambda k: F.lit(k), lambda k: F.when(n > k, k + 1).otherwise(0), F.lit(0))
    above = chosen(lambda k: n - k, lambda k: n - k - 1, F.when(fqdn.rlike(IPV4), 0).otherwise(n - 1))
    hit = F.lit(False)
    for k in range(1, longest + 1):
        hit = hit | (at[k].bitwiseAND(ALLOWED) != 0)
    if rest := allowed - shallow:
        df, below = _with_below(df, rest)
        hit = hit | below
    df = df.withColumns({
        "is_allowed": hit,
        "suffix": _labels_from(fqdn, -size),
        "registrable": F.regexp_replace(_labels_from(fqdn, -taken), r"^\..*", ""),
        "subdomain": _labels_from(fqdn, F.greatest(above, F.lit(0))),
    })
    df = df.withColumn("core", F.substring_index("registrable", ".", 1))
    return df.drop("_below", *(f"_{w}{k}" for k in range(1, longest + 1) for w in ("name", "bits")))


def _with_below(df: DataFrame, names: frozenset[str]) -> tuple[DataFrame, Column]:
    """Adds ``_below``, true for names equal to or below one of ``names``: for names deeper than any suffix rule, or very many.

    Different names are expanded to their last 1, 2, ... labels, as many as some of ``names`` has, and joined with them.
    """
    depths = sorted({x.count(".") + 1 for x in names})
    table = df.sparkSession.createDataFrame(pa.table({"_end": pa.array(sorted(names), pa.string())}))
    ends = F.array(*(F.when(F.col("n_labels") >= k, last_labels(F.col("fqdn"), k)) for k in depths))
    seen = df.where(F.col("n_labels") >= depths[0]).select("fqdn", "n_labels").distinct().select("fqdn", F.explode(F.array_compact(ends)).alias("_end"))
    hits = seen.join(table, "_end", "left_semi").select("fqdn").distinct().withColumn("_below", F.lit(True))
    return df.join(hits, "fqdn", "left"), F.coalesce("_below", F.lit(False))


def with_names(df: DataFrame, host: str, rules: SuffixRules, allowed: frozenset[str] = frozenset()) -> DataFrame:
    """``with_fqdn`` and ``with_parts`` of the raw host name."""
    return with_parts(with_fqdn(df, host), rules, allowed)


def tokens(name: Column) -> Column:
    """Non-empty pieces between dots and hyphens."""
    return F.filter(F.split(name, "[.-]+"), lambda t: t != "")
