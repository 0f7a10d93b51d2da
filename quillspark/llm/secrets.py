"""Secret scans with a trigram inverted index (DataFrame functions only).

Each rule's regex gives a Boolean query over trigrams: an OR of alternatives, each an AND of the
trigrams that every match of it must hold. Postings (trigram, document key) are made for those
trigrams, intersected per alternative with a bit mask, and the candidates are verified with the rule
itself. Rules without mandatory trigrams scan every text. Document keys are hashes of whole rows:
a collision costs a needless verification and never loses a match, and no key is a hot one unless
whole rows are equal.

Defined results: null and empty texts hold no secret; texts of any length are scanned whole; spans that
start at one place go by kind; equal rows each get their result; columns of any name are carried along, but one
named secrets gives way to the result.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read, spans, sql_text, text_of, unused, written

_p = re._parser  # the parser of the standard library's own regexes

SPANS = "array<struct<s:int,k:int,e:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """``least`` drops matches whose group ``group`` is shorter; ``base`` marks the contract's kinds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: Fixed values. The first three kinds come first in the order of kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._-]{1,64}:[^\s:/@]{3,64}@"),
    Rule("twilio", r"\bSK[0-9a-f]{32}\b"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{40,}"),
    Rule("gitlab_trigger", r"glptt-[0-9a-f]{40}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("discord_hook", r"discord(?:app)?\.com/api/webhooks/[0-9]{17,20}/[A-Za-z0-9_-]{60,}"),
    Rule("google_oauth", r"ya29\.[A-Za-z0-9_-]{20,}"),
    Rule("google_client", r"GOCSPX-[A-Za-z0-9_-]{28}"),
    Rule("firebase", r"AAAA[A-Za-z0-9_-]{7}:APA91b[A-Za-z0-9_-]{100,}"),
    Rule("azure_storage", r"AccountKey=[A-Za-z0-9+/]{60,}={0,2}"),
    Rule("aws_secret", r"(?i:aws_secret_access_key)\x20*[=:]\x20*[A-Za-z0-9/+]{40}"),
    Rule("mws", r"amzn\.mws\.[0-9a-f-]{36}"),
    Rule("shopify", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}"),
    Rule("square", r"sq0(?:atp|csp)-[A-Za-z0-9_-]{22,}"),
    Rule("digitalocean", r"do[por]_v1_[0-9a-f]{64}"),
    Rule("pypi", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}"),
    Rule("rubygems", r"rubygems_[0-9a-f]{48}"),
    Rule("docker", r"dckr_pat_[A-Za-z0-9_-]{20,}"),
    Rule("databricks", r"dapi[0-9a-f]{32}"),
    Rule("postman", r"PMAK-[0-9a-f]{24}-[0-9a-f]{34}"),
    Rule("mailchimp", r"[0-9a-f]{32}-us[0-9]{1,2}\b"),
    Rule("mailgun", r"key-[0-9a-f]{32}"),
    Rule("newrelic", r"NRAK-[A-Z0-9]{27}"),
    Rule("linear", r"lin_api_[A-Za-z0-9]{40}"),
    Rule("vault", r"hvs\.[A-Za-z0-9_-]{24,}"),
    Rule("age", r"AGE-SECRET-KEY-1[A-Z0-9]{58}"),
    Rule("pgp", r"-----BEGIN PGP PRIVATE KEY BLOCK-----"),
)

#: A rule with more alternatives than this, or a character class with more members, ends the literal run there.
MOST_ALTERNATIVES, MOST_MEMBERS = 64, 8
#: Trigrams of an alternative that are looked up, spread over its literals; verification does not need the others.
MOST_GRAMS = 3


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The OR of ANDs of lower-cased trigrams that a match must satisfy; None if some match needs none.

    Of an alternative's trigrams at most MOST_GRAMS are named: a weaker query that every match still satisfies.
    """

    # A state is (runs that ended, the run that is open).
    def walk(items, states: list[tuple[tuple[str, ...], str]]) -> list[tuple[tuple[str, ...], str]]:
        for op, arg in items:
            states = step(str(op), arg, states)
            if len(states) > MOST_ALTERNATIVES:
                states = [((), "")]
        return states

    def ended(states):
        return list(dict.fromkeys(((*runs, run) if len(run) > 2 else runs, "") for runs, run in states))

    def step(op, arg, states):
        if op == "LITERAL":
            if arg > 127:
                return ended(states)
            return [(runs, run + chr(arg).lower()) for runs, run in states]
        if op == "IN" and len(arg) <= MOST_MEMBERS and all(str(o) == "LITERAL" and a < 128 for o, a in arg):
            members = dict.fromkeys(chr(a).lower() for _, a in arg)
            return [(runs, run + c) for (runs, run), c in itertools.product(states, members)]
        if op == "BRANCH":
            return list(dict.fromkeys(s for branch in arg[1] for s in walk(branch, states)))
        if op == "SUBPATTERN":
            return walk(arg[3], states)
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            if (least, most) == (0, 1):
                return list(dict.fromkeys([*states, *walk(inner, states)]))
            for _ in range(min(least, 3)):
                states = walk(inner, states)
            return states if least == most <= 3 else ended(states)
        if op in ("AT", "ASSERT", "ASSERT_NOT"):
            return states
        return ended(states)

    out = []
    for runs, _ in ended(walk(_p.parse(pattern), [((), "")])):
        grams = list(dict.fromkeys(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
        if not grams:
            return None
        n = min(MOST_GRAMS, len(grams))
        out.append(frozenset(grams[i * (len(grams) - 1) // max(n - 1, 1)] for i in range(n)))
    # a alone covers (a and b)
    return list(dict.fromkeys(a for a in out if not any(b < a for b in out)))


def _kept(rule: Rule, k: int, text: str) -> str:
    found = spans(text, sql_text(rule.pattern))
    if rule.least:
        part = "x.hit" if not rule.group else f"regexp_extract(x.hit, {sql_text(rule.pattern)}, {rule.group})"
        found = f"filter({found}, x -> char_length({part}) >= {rule.least})"
    return f"transform({found}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'kind', {sql_text(rule.kind)}))"


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``secrets``: each match as (s, k, e, kind) in order of start, then kind; code points, end exclusive."""
    spark = docs.sparkSession
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    grams = sorted({g for q in queries.values() if q for alternative in q for g in alternative})
    key, live, body = unused(docs, "key", "rules", "t")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    df = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in plain]))

    if grams:
        # Postings: one row per trigram that the text holds.
        present = F.array_compact(F.array(*[F.when(F.contains(F.col("l"), F.lit(g)), F.lit(g)) for g in grams]))
        postings = df.select(F.col(key).alias("key"), F.lower(text_of(f"`{text}`")).alias("l")).select("key", F.explode(present).alias("gram"))
        wanted = spark.createDataFrame(
            [(g, i, j, 1 << b, (1 << len(a)) - 1) for i, q in queries.items() if q for j, a in enumerate(q) for b, g in enumerate(sorted(a))],
            "gram string, rule int, alternative int, bit long, full long",
        )
        # The query table is as small as the rules; its size doesn't depend on the data.
        found = (
            postings.join(F.broadcast(wanted), "gram")
            .groupBy("key", "rule", "alternative", "full")
            .agg(F.bit_or("bit").alias("bits"))
            .filter("bits = full")
            .groupBy("key")
            .agg(F.collect_set("rule").alias("rules"))
        )
        # Candidates are written, so that their true size settles how they meet the texts: where they are few, these stay in place.
        df = df.join(written(found.toDF(key, live)), key, "left")
    else:
        df = df.withColumn(live, F.lit(None).cast("array<int>"))
    df = df.withColumn(body, text_of(f"`{text}`"))
    parts = []
    for i, rule in enumerate(rules):
        # For full scans a cheap test comes before the spans.
        test = f"array_contains({live}, {i})" if queries[i] else f"{body} rlike {sql_text(_test(rule))}"
        parts.append(f"case when {test} then {_kept(rule, i, body)} else cast(array() as {SPANS}) end")
    df = df.withColumn("secrets", F.expr(f"array_sort(concat({', '.join(parts)}))"))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "secrets"], "secrets")


def _test(rule: Rule) -> str:
    """A regex that any text with a match that is kept matches."""
    if rule.least and not rule.group and rule.pattern.endswith("]+") and rule.pattern.startswith("["):
        return rule.pattern[:-1] + f"{{{rule.least}}}"
    return rule.pattern


def redacted(text: Column | str = "text", secrets: str = "secrets", mask: str = "[secret]") -> Column:
    """The text with every run of overlapping or touching spans replaced by ``mask``."""
    name = text if isinstance(text, str) else "__text"
    # at: end of what is done; out: the text so far. Spans come in order of their starts.
    return F.expr(
        f"aggregate({secrets}, named_struct('at', 0, 'out', ''), (acc, x) -> case when x.e <= acc.at then acc "
        f"when x.s <= acc.at and acc.at > 0 then named_struct('at', x.e, 'out', acc.out) "
        f"else named_struct('at', x.e, 'out', concat(acc.out, substring({name}, acc.at + 1, x.s - acc.at), {sql_text(mask)})) end, "
        f"acc -> concat(acc.out, substring({name}, acc.at + 1)))"
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts of the base kinds, their digest, and all spans."""
    df = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')"
    n = "cast(size(filter(secrets, x -> x.kind = '{}')) as bigint)"
    kinds = ", ".join(sql_text(r.kind) for r in RULES if r.base)
    return df.select(
        "doc_id",
        *[F.expr(n.format(r.kind)).alias(f"n_{r.kind}") for r in RULES if r.base],
        F.expr(f"sha2({joined.format(f'filter(secrets, x -> x.kind in ({kinds}))')}, 256)").alias("base_sha256"),
        F.expr(joined.format("secrets")).alias("spans"),
    )
