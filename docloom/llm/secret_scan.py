"""Operator 13, secret scans with linked credentials, from built-in functions alone.

Base patterns report on their own: assignments to a secret's name, access identifiers, long runs of hex digits. What is too
weak for that (a user name, a short password, a random looking word, an address of a service) is a candidate. The parts of
a multipart credential stand together, so candidates are reported only where complementary ones co-occur: an
interval join brings every candidate, widened by REACH characters to both sides, together with the other parts of its
scope. A scope is a block of a text between blank lines. A secret needs an identifier or an endpoint, an identifier
needs a secret, an endpoint needs both; the base spans count as parts, too. Candidates that overlap a base span say nothing new
and go.

Positions come without a position function: a pattern's matches and the texts between them, from the same
pattern, add up to running totals. These are window sums over the matches of one text, so a text with very many matches
costs in proportion. Only short numbers of matches leave the scan of the texts.

Cases: a null text is empty; a null or repeated doc_id is a document of its own, as rows have a key of their own; equal
spans of one kind count once; ties of start are ordered by kind, then end; texts of any length are searched whole; an empty table
gives an empty one; other columns pass through, whatever their names, but those named like the results, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.intervals import interval_join

from .common import let, materialize, read_table, store, temporary_stores

#: Characters between the spans of parts that belong together, at most.
REACH = 200


def either_case(words: str) -> str:
    """The ASCII letters of a pattern in either case, without a flag that would fold others."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def assigned(names: str, value: str) -> str:
    """A name, perhaps quoted, a colon or equals sign, and a value as group 2."""
    return rf"""({either_case(names)})["']?\x20*[:=]\x20*["']?({value})"""


@dataclass(frozen=True)
class Part:
    """Matches of pattern whose group has `least` characters. Patterns of the base kinds are those of the contract (runs of a
    class need no retry, so their least length can stand in the pattern)."""

    kind: str
    role: str
    pattern: str
    group: int = 0
    least: int = 1
    mixed: bool = False


#: By kind as spans are ordered; those marked base report on their own. A break ends a scope.
PARTS = (
    Part("assign", "secret", assigned("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+"), 2, 12),
    Part("access", "identifier", "AKIA[A-Z0-9]{14,}"),
    Part("hex", "secret", "[0-9a-f]{16,}"),
    Part("identifier", "identifier", assigned("username|user|login|account|client_?id|access_?key_?id|access_?key|key_?id", "[A-Za-z0-9@._-]+"), 2, 3),
    Part("secret", "secret", assigned("password|passwd|passphrase|pass|pwd|secret|token|credential|private_?key|api_?key", "[A-Za-z0-9+/_.=!@#$%^&*~-]+"), 2, 6),
    Part("secret", "secret", "[A-Za-z0-9+/]{24,}", mixed=True),
    Part("endpoint", "endpoint", either_case("https?|ftps?|sftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqps?|ldaps?").join(("(", ")")) + r"://[!#-&(-;=?-~]+"),
    Part("endpoint", "endpoint", assigned("hostname|host|endpoint|server", "[A-Za-z0-9.-]+"), 2, 4),
    Part("break", "", r"\n[\x20\t\r]*\n"),
)
BASE, BREAK = 3, len(PARTS) - 1
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")


def matches(text: Column, number: int) -> Column:
    """array<struct<part, i, gap, len, ok>>: every match of a part's pattern, the length of the text before it since the
    last one, its own, and whether its value will do."""
    part = PARTS[number]

    def of(parts: Column, found: Column, values: Column) -> Column:
        def row(m: Column, i: Column) -> Column:
            ok = F.length(F.get(values, i)) >= part.least
            if part.mixed:
                ok = ok & m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
            return F.struct(F.lit(number).alias("part"), i.alias("i"), F.length(F.get(parts, i)).alias("gap"), F.length(m).alias("len"), ok.alias("ok"))

        return F.transform(found, row)

    def found(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(part.pattern), F.lit(group))

    if part.group:
        made = let(F.split(text, part.pattern, -1), lambda p: let(found(0), lambda m: let(found(part.group), lambda v: of(p, m, v))))
    else:
        made = let(F.split(text, part.pattern, -1), lambda p: let(found(0), lambda m: of(p, m, m)))
    return F.when(text.rlike(part.pattern), made).otherwise(F.array().cast(_FOUND))


_FOUND = "array<struct<part:int,i:int,gap:int,len:int,ok:boolean>>"


def found_in(docs: DataFrame, text: str = "text") -> DataFrame:
    """(uid, row, found): one scan of the texts. row holds the other columns, whatever their names; uid is a number for each
    row, which stays once this is stored."""
    row = F.struct(*[docs[c] for c in docs.columns if c != text], F.lit(0).alias("__none"))
    out = docs.select(row.alias("row"), F.monotonically_increasing_id().alias("uid"), F.coalesce(docs[text], F.lit("")).alias("text"))
    t = F.col("text")
    out = out.select("uid", "row", "text", F.concat(*[matches(t, k) for k in range(BREAK)]).alias("found"))
    weak = F.exists("found", lambda x: x["ok"] & (x["part"] >= BASE))
    return out.select("uid", "row", F.when(weak, F.concat("found", matches(t, BREAK))).otherwise(F.col("found")).alias("found"))


def positions(found: DataFrame) -> DataFrame:
    """(uid, scope, part, start, end, weak) of all matches that will do; weak: whether the document has candidates."""
    # weak comes before the explosion: a column that is made of the array afterwards would copy it into every row.
    rows = found.where(F.size("found") > 0).select("uid", F.exists("found", lambda x: x["ok"] & (x["part"] >= BASE)).alias("weak"), "found")
    rows = rows.select("uid", "weak", F.explode("found").alias("m")).select("uid", "weak", "m.*").repartition("uid")
    total = F.sum(F.col("gap").cast("long") + F.col("len")).over(Window.partitionBy("uid", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", total).where("ok").withColumn("start", F.col("end") - F.col("len"))
    before = Window.partitionBy("uid").orderBy("start", F.col("part").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("scope", F.sum((F.col("part") == BREAK).cast("long")).over(before))
    return rows.where(F.col("part") != BREAK).select("uid", "scope", "part", "start", "end", "weak").distinct()


def role_of(part: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p.role) for p in PARTS]), part + 1)


def kind_of(part: Column) -> Column:
    """The place of a part's kind in KINDS."""
    return F.element_at(F.array(*[F.lit(KINDS.index(p.kind) if p.kind in KINDS else -1) for p in PARTS]), part + 1)


def linked(parts: DataFrame) -> DataFrame:
    """The candidates beside which their complements stand: uid, part, start, end."""
    parts = parts.where("weak").drop("weak")
    candidates = parts.where(F.col("part") >= BASE).withColumn("from", F.col("start") - REACH).withColumn("to", F.col("end") + REACH)
    met = interval_join(candidates, parts, ["uid", "scope"], ("from", "to"), ("start", "end"))
    a, b = F.col("left"), F.col("right")
    apart = (a["end"] <= b["start"]) | (b["end"] <= a["start"])

    def beside(role: str) -> Column:
        return F.max(apart & (role_of(b["part"]) == role)).alias(f"by_{role}")

    known = F.max(~apart & (b["part"] < BASE)).alias("known")
    each = met.groupBy("uid", a["part"].alias("part"), a["start"].alias("start"), a["end"].alias("end")).agg(known, *map(beside, ("identifier", "secret", "endpoint")))
    role = role_of(F.col("part"))
    complete = (
        F.when(role == "identifier", F.col("by_secret")).when(role == "secret", F.col("by_identifier") | F.col("by_endpoint")).otherwise(F.col("by_identifier") & F.col("by_secret"))
    )
    return each.where(~F.col("known") & complete).select("uid", "part", "start", "end")


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_assign, n_access, n_hex, n_linked and spans: array<struct<start, kind, end>>, kind as a
    number into KINDS."""
    with temporary_stores(docs.sparkSession):
        found = store(found_in(docs, text))
        parts = store(positions(found))
        spans = parts.where(F.col("part") < BASE).select("uid", "part", "start", "end").unionByName(linked(parts))
        spans = spans.select("uid", F.struct("start", kind_of(F.col("part")).alias("kind"), "end").alias("s")).groupBy("uid").agg(F.sort_array(F.collect_set("s")).alias("spans"))
        none = F.array().cast(spans.schema["spans"].dataType)
        with_some = found.where(F.size("found") > 0).select("uid", "row").join(spans, "uid", "left").select("row", F.coalesce("spans", none).alias("spans"))
        out = with_some.unionByName(found.where(F.size("found") == 0).select("row", none.alias("spans")))
        made = [*(_count(k).alias(f"n_{KINDS[k]}") for k in range(BASE)), F.size(F.filter("spans", lambda s: s["kind"] >= BASE)).cast("long").alias("n_linked"), F.col("spans")]
        names = {*(f"n_{k}" for k in KINDS[:BASE]), "n_linked", "spans"}
        others = [F.col("row").getField(c).alias(c) for c in docs.columns if c != text and c not in names]
        return materialize(out.select(*others, *made))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), "n_linked")


def _sql_matches(k: int, p: Part) -> str:
    pattern = p.pattern.replace("'", "''")
    ok = f"length(v) >= {p.least}" + " AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')" * p.mixed
    return f"""SELECT uid, {k} AS part, '{p.kind}' AS kind, {max(0, KINDS.index(p.kind) if p.kind in KINDS else 9)} AS place, '{p.role}' AS role, i, m, g, {ok} AS ok FROM (
    SELECT uid, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g FROM (
      SELECT uid, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {p.group}) AS vs, string_split_regex(t, '{pattern}') AS gs FROM d) WHERE len(ms) > 0)"""


_UNION = "\n  UNION ALL ".join(_sql_matches(k, p) for k, p in enumerate(PARTS))
_ROLES = "\n         ".join(f"max(c.role <> '' AND (w.stop <= c.start OR c.stop <= w.start) AND c.role = '{r}') AS by_{r}," for r in ("identifier", "secret", "endpoint"))
#: The same in DuckDB's SQL, with a plain range join.
SQL_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  {_UNION}
), e AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY uid, part ORDER BY i) AS stop FROM m
), f AS (SELECT *, stop - length(m) AS start FROM e WHERE ok
), s AS (SELECT *, sum((kind = 'break')::INT) OVER (PARTITION BY uid ORDER BY start, part DESC ROWS UNBOUNDED PRECEDING) AS scope FROM f
), c AS (SELECT DISTINCT uid, scope, part, kind, place, role, start, stop FROM s WHERE kind <> 'break'
), w AS (
  SELECT w.uid, w.part, w.place, w.kind, w.role, w.start, w.stop,
         {_ROLES}
         max(NOT (w.stop <= c.start OR c.stop <= w.start) AND c.part < {BASE}) AS known
  FROM c AS w JOIN c ON c.uid = w.uid AND c.scope = w.scope AND c.start < w.stop + {REACH} AND w.start - {REACH} < c.stop
  WHERE w.part >= {BASE} GROUP BY w.uid, w.part, w.place, w.kind, w.role, w.start, w.stop
), x AS (
  SELECT uid, place, kind, start, stop FROM c WHERE part < {BASE}
  UNION SELECT uid, place, kind, start, stop FROM w
  WHERE NOT known AND CASE role WHEN 'identifier' THEN by_secret WHEN 'secret' THEN by_identifier OR by_endpoint ELSE by_identifier AND by_secret END
), g AS (
  SELECT uid, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         count(*) FILTER (place >= {BASE}) AS n_linked,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place, stop) FILTER (place < {BASE}) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place, stop) AS spans
  FROM x GROUP BY uid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0)::BIGINT AS n_linked
FROM d LEFT JOIN g USING (uid)
"""
