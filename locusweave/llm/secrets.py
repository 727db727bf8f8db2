"""Secret scanning with corpus-wide ownership frequency; DataFrame functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.llm.spans import listing
from locusweave.session import materialize

# The base patterns, the group that holds the secret, and the characters it needs at least.
KINDS = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
}
#: What the ownership rule may add: long runs of key characters with letters and digits.
TOKEN = r"([A-Za-z0-9+/_=-]{16,})"
ORDER = (*KINDS, "live")
_SPAN = "array<struct<start:int,rank:int,stop:int,value:string>>"


def _matches(pattern: str, group: int, least: int, rank: int, mixed: bool = False) -> Column:
    """Spans of all leftmost matches, in code points: the text between matches gives their places."""
    text, none = F.col("txt"), F.array().cast(_SPAN)
    parts = F.arrays_zip(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
    )

    def step(s: Column, x: Column) -> Column:
        gap, hit, value = x["0"], x["1"], x["2"]
        start = s["at"] + F.length(gap)
        stop = start + F.coalesce(F.length(hit), F.lit(0))
        good = hit.isNotNull() & (F.length(value) >= least)
        if mixed:
            good = good & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), value.alias("value"))
        return F.struct(stop.alias("at"), F.when(good, F.array_append(s["found"], span)).otherwise(s["found"]).alias("found"))

    first = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.when(text.rlike(pattern), F.aggregate(parts, first, step, lambda s: s["found"])).otherwise(none)


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Per row: doc_id, owner, repository, a digest of the text, base spans and further candidate tokens."""
    source = docs.select(
        "doc_id", owner.cast("string").alias("owner"), repository.cast("string").alias("repository"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("txt"),
    )
    base = [_matches(*KINDS[k], rank).alias(k) for rank, k in enumerate(KINDS)]
    wide = source.select(
        "doc_id", "owner", "repository", F.md5("txt").alias("digest"), *base,
        _matches(TOKEN, 1, 16, len(KINDS), mixed=True).alias("tokens"),
    )
    spans = F.concat(*[F.col(k) for k in KINDS])
    apart = lambda t: ~F.exists(
        F.col("base"), lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])
    )
    return wide.select(
        "doc_id", "owner", "repository", "digest", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.array_sort(spans).alias("base"), "tokens",
    ).withColumn("tokens", F.when(F.size("base") == 0, F.col("tokens")).otherwise(F.filter("tokens", apart)))


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repositories, n_texts) of every candidate in the corpus.

    A row without owner counts under one unnamed owner.  Copies are folded before values meet: the first
    aggregate keeps one row per value, repository and owner, so a value copied everywhere costs no more than its owners.
    """
    one = found.where((F.size("base") > 0) | (F.size("tokens") > 0)).select(
        F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"),
        F.explode(F.array_distinct(F.transform(F.concat("base", "tokens"), lambda s: F.xxhash64(s["value"])))).alias("value_hash"),
    )
    per_place = one.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_place.groupBy("value_hash", "owner").agg(
        F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n")
    )
    return per_owner.groupBy("value_hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_rows")
    )


def judged(found: DataFrame, copied_owners: int = 3) -> DataFrame:
    """(digest, verdicts): for each text with candidates its spans and whether each is owner-specific."""
    per_text = (
        found.where((F.size("base") > 0) | (F.size("tokens") > 0))
        .groupBy("digest").agg(F.first("base").alias("base"), F.first("tokens").alias("tokens"))
        .select("digest", F.explode(F.concat("base", "tokens")).alias("span"))
        .withColumn("value_hash", F.xxhash64("span.value"))
    )
    verdict = F.struct("span.start", "span.rank", "span.stop", (F.col("n_owners") < copied_owners).alias("live"))
    return (
        per_text.join(ownership(found).select("value_hash", "n_owners"), "value_hash")
        .groupBy("digest").agg(F.array_sort(F.collect_list(verdict)).alias("verdicts"))
    )


def secret_spans(
    docs: DataFrame, owner: Column | None = None, repository: Column | None = None, copied_owners: int = 3
) -> DataFrame:
    """One row per row of ``docs``: base counts and spans, and the spans that ownership adds.

    A candidate value that ``copied_owners`` or more owners share is a widely copied example; fewer owners make
    it owner-specific and live-looking.  Long mixed tokens outside the base spans become spans of kind
    ``live`` when they are owner-specific; base spans stay whatever their verdict.  n_live and n_copied count the
    base and added spans by verdict; ``live_spans`` lists the owner-specific ones as (start, stop).

    A null text is empty.  Without arguments the owner is ``source`` and a repository is a source's part in one
    language; null owners count as one unnamed owner.  Repeated rows give repeated results, an empty table none.
    """
    owner = docs["source"] if owner is None else owner
    repository = F.concat_ws("/", docs["source"], docs["lang"]) if repository is None else repository
    found = materialize(scan(docs, owner, repository))
    joined = found.join(judged(found, copied_owners), "digest", "left").withColumn(
        "verdicts", F.coalesce("verdicts", F.expr("CAST(array() AS array<struct<start:int,rank:int,stop:int,live:boolean>>)"))
    )
    live = F.filter("verdicts", lambda v: v["live"])
    base_or_live = F.filter("verdicts", lambda v: v["live"] | (v["rank"] < len(KINDS)))
    base = F.filter("verdicts", lambda v: v["rank"] < len(KINDS))
    return joined.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(listing(base, ORDER), 256).alias("base_sha256"),
        listing(base_or_live, ORDER).alias("spans"), F.size(live).cast("bigint").alias("n_live"),
        (F.size(base_or_live) - F.size(live)).cast("bigint").alias("n_copied"),
        F.transform(live, lambda v: F.struct(v["start"].alias("start"), v["stop"].alias("stop"))).alias("live_spans"),
        "digest",
    )


def redact(docs: DataFrame, mark: str = "<secret>", **options) -> DataFrame:
    """``docs`` with every owner-specific secret replaced by ``mark``; widely copied examples stay.

    Columns and rows stay as they are; ``n_chars``, if there is one, follows the text.  A null text stays null.
    """
    spans = secret_spans(docs, **options).where("n_live > 0").select(
        F.col("digest").alias("_digest"), F.col("live_spans").alias("_live")
    ).groupBy("_digest").agg(F.first("_live").alias("_live"))
    marked = docs.withColumn("_digest", F.md5(docs["text"].cast("string"))).join(spans, "_digest", "left")

    def step(s: Column, x: Column) -> Column:
        before = F.substring("text", s["at"] + 1, x["start"] - s["at"])
        more = F.when(x["start"] < s["at"], s["made"]).otherwise(F.concat(s["made"], F.array(before, F.lit(mark))))
        return F.when(x["stop"] <= s["at"], s).otherwise(F.struct(x["stop"].alias("at"), more.alias("made")))

    first = F.struct(F.lit(0).alias("at"), F.array(F.lit("")).alias("made"))
    whole = F.length("text")
    pieces = F.aggregate(
        "_live", first, step, lambda s: F.concat(F.array_join(s["made"], ""), F.substring("text", s["at"] + 1, whole))
    )
    out = marked.withColumn("text", F.when(F.col("_live").isNull(), F.col("text")).otherwise(pieces))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("_live").isNull(), F.col("n_chars")).otherwise(changed))
    return out.select(*docs.columns)
