"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns stand on their own. Weak ones (bare key ids, opaque strings, endpoints) are reported only where complementary parts
co-occur within a scope of characters: an identifier near a secret, a secret near an identifier or endpoint, an endpoint near both.
The interval join of parts is a pass over each document's spans in order: the nearest part of each role on either side decides, so
no pairs are made.

Places are code points, end exclusive. They come from the gaps between matches, so no position function or marker is needed.

Defined cases: NULL and empty texts have no spans (empty strings and zero counts); repeated rows and ids are scanned one by one;
an empty table gives an empty result; other columns are ignored or, in `redact`, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlab.staging import stage

# The base patterns and their least lengths, in the order of kinds.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
# Equivalent to the hex pattern above its least length, and much rarer to match: runs are maximal either way.
SEARCH = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
WEAK = (
    ("key_id", r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[0-9])[A-Z][A-Z0-9]{15,31}(?![A-Za-z0-9])"),
    ("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}"),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\x00-\x20\"'<>]*"),
)
KINDS = tuple(k[0] for k in BASE) + tuple(k[0] for k in WEAK)
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "id", "key_id": "id", "endpoint": "endpoint"}
SCOPE = 400


def _lengths(text: Column, pattern: str, group: int) -> tuple[Column, Column, Column]:
    """Lengths of the gaps, of the matches, and of the group that is measured, in order; NULL without a match."""
    hit = text.rlike(pattern)

    def sizes(parts: Column) -> Column:
        return F.when(hit, F.transform(parts, F.length))

    return (sizes(F.split(text, pattern, -1)), sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
            sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.lit(None).cast("array<int>"))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def _places(name: str, least: int, order: int) -> Column:
    """(start, kind as number, end) of matches that are long enough."""
    gaps, sizes, part = F.col(f"g_{name}"), F.col(f"m_{name}"), F.col(f"p_{name}")

    def place(size: Column, i: Column) -> Column:
        start = _total(F.slice(gaps, F.lit(1), i + 1)) + _total(F.slice(sizes, F.lit(1), i))
        return F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + size).alias("end"),
                        F.coalesce(F.get(part, i), size).alias("size"))

    found = F.filter(F.transform(sizes, place), lambda x: x.size >= least)
    return F.coalesce(F.transform(found, lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"))),
                      F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _named(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, carry: bool = False) -> DataFrame:
    """(doc_id, base, found): arrays of (start, kind, end) per row; `found` adds weak spans whose parts co-occur within `scope`.

    `carry` adds the whole row as one struct, `row`. Texts are read once; what linking shuffles are places in rows with weak spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = {}
    for name, pattern, group, _ in BASE:
        parts |= dict(zip((f"g_{name}", f"m_{name}", f"p_{name}"), _lengths(text, SEARCH.get(name, pattern), group)))
    for name, pattern in WEAK:
        parts |= dict(zip((f"g_{name}", f"m_{name}", f"p_{name}"), _lengths(text, pattern, 0)))
    row = ["row"] if carry else []
    read = stage(docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("rk"), *[F.struct("*").alias(c) for c in row],
        *[c.alias(k) for k, c in parts.items()]))
    base = F.concat(*[_places(name, least, i) for i, (name, _, _, least) in enumerate(BASE)])
    weak = F.concat(*[_places(name, 1, len(BASE) + i) for i, (name, _) in enumerate(WEAK)])
    spans = read.select("doc_id", *row, "rk", base.alias("base"), weak.alias("weak"))
    # Only rows with a weak candidate need linking; equal rows have equal spans, so one of them decides for all.
    linked = link(spans.where(F.size("weak") > 0).select("rk", "base", "weak").dropDuplicates(["rk"]), scope)
    return spans.join(linked, "rk", "left").select(
        "doc_id", *row, "base", F.coalesce(F.concat("base", "linked"), F.col("base")).alias("found"))


def link(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(rk, linked): weak spans with complementary parts within `scope` characters."""
    every = spans.select("rk", F.explode(F.concat("base", "weak")).alias("x")).select("rk", "x", "x.*")
    roles = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    every = every.withColumn("role", F.get(roles, F.col("kind")))
    order = Window.partitionBy("rk").orderBy("start", "end", "kind")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def near(role: str) -> Column:
        # The end reached so far, and the next start: the closest part of that role on either side.
        before = F.max(F.when(F.col("role") == role, F.col("end"))).over(back)
        after = F.min(F.when(F.col("role") == role, F.col("start"))).over(ahead)
        return F.coalesce(F.col("start") - before <= scope, F.lit(False)) | F.coalesce(after - F.col("end") <= scope, F.lit(False))

    every = every.withColumns({f"near_{r}": near(r) for r in ("id", "secret", "endpoint")})
    whole = (F.when(F.col("role") == "id", F.col("near_secret"))
             .when(F.col("role") == "secret", F.col("near_id") | F.col("near_endpoint"))
             .otherwise(F.col("near_id") & F.col("near_secret")))
    # A weak span inside a strong one is the same string seen twice.
    strong = F.max(F.when(F.col("kind") < len(BASE), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    every = every.withColumn("inside", F.coalesce(F.col("end") <= strong, F.lit(False)))
    return every.where((F.col("kind") >= len(BASE)) & whole & ~F.col("inside")).groupBy("rk").agg(F.collect_list("x").alias("linked"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Counts of base kinds, a digest of base spans, and all spans, of every document."""
    found = scan(docs, id_col, text_col, scope)
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x.kind == kind)).cast("bigint")

    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)], F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("found")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, mark: str = "[secret]") -> DataFrame:
    """The rows of `docs` with every reported span replaced by `mark`; rows without spans are unchanged."""
    found = scan(docs, id_col, text_col, scope, carry=True)
    text, spans = F.col("row").getField(text_col), F.col("_spans")

    def piece(x: Column, i: Column) -> Column:
        # From the end reached by the spans before to the start of this one; overlapping spans are one.
        return F.concat(F.substring(text, x.reach + 1, F.greatest(F.lit(0), x.start - x.reach)),
                        F.when((x.start > x.reach) | (i == 0), F.lit(mark)).otherwise(F.lit("")))

    reach = F.transform(F.array_sort("found"), lambda x: F.struct(
        x.start.alias("start"), x.end.alias("end"),
        F.coalesce(F.array_max(F.transform(F.filter("found", lambda y: y < x), lambda y: y.end)), F.lit(0)).alias("reach")))
    found = found.withColumn("_spans", reach)
    tail = F.substring(text, F.array_max(F.transform(spans, lambda x: F.greatest(x.end, x.reach))) + 1, F.length(text))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(spans, piece), ""), tail)).otherwise(text)
    return found.select([clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
