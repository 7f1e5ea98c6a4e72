"""Steps of building the corpus: incremental selection, caches, upserts, validation, quotes and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The closed vocabularies of an enriched record.
FORMS = """bias fallacy paradox thought_experiment effect heuristic phenomenon concept principle misconception law hypothesis
device archetype anti_pattern game defense_mechanism""".split()
DOMAINS = """cognitive_science psychology philosophy logic mathematics physics biology economics linguistics sociology
computer_science decision_theory perception ethics narrative rhetoric software_engineering game_theory history religion
aesthetics other""".split()
AFFECTS = "mind_bending practical unsettling wholesome melancholic existential funny sobering neutral".split()
#: Display names of facet values, by kind of facet; others are shown as they are.
LABELS = {
    "form": {
        "bias": "Cognitive bias",
        "fallacy": "Fallacy",
        "paradox": "Paradox",
        "thought_experiment": "Thought experiment",
        "effect": "Named effect",
        "heuristic": "Heuristic",
        "phenomenon": "Phenomenon",
        "concept": "Concept",
        "principle": "Principle",
        "misconception": "Misconception",
        "law": "Law",
        "hypothesis": "Hypothesis",
    },
    "domain": {
        "cognitive_science": "Cognitive science",
        "psychology": "Psychology",
        "philosophy": "Philosophy",
        "logic": "Logic",
        "mathematics": "Mathematics",
        "physics": "Physics",
        "biology": "Biology",
        "economics": "Economics",
        "linguistics": "Linguistics",
        "sociology": "Sociology",
        "computer_science": "Computer science",
        "decision_theory": "Decision theory",
        "perception": "Perception",
        "ethics": "Ethics",
        "other": "Other",
    },
    "affect": {
        "mind_bending": "Mind-bending",
        "practical": "Practical",
        "unsettling": "Unsettling",
        "wholesome": "Wholesome",
        "melancholic": "Melancholic",
        "existential": "Existential",
        "funny": "Funny",
        "sobering": "Sobering",
        "neutral": "Neutral",
    },
    "source": {
        "cognitive_biases": "Cognitive biases",
        "fallacies": "Fallacies",
        "paradoxes": "Paradoxes",
        "thought_experiments": "Thought experiments",
        "effects": "Named effects",
    },
}
#: The score under which a concept is dropped, and the reason given.
LEAST_SURPRISE, LOW_SURPRISE = 4, "low_surprise"


def label(kind: str, c):
    """The display name of a facet value of a kind (see LABELS), or the value itself."""
    table = F.create_map(*[F.lit(x) for kv in LABELS[kind].items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def dropped(df: DataFrame, least: int = LEAST_SURPRISE) -> DataFrame:
    """``df`` with dropped (0 or 1) and drop_reason by its surprise_score; a null score drops nothing."""
    low = F.coalesce(F.col("surprise_score") < least, F.lit(False))
    return df.withColumns({"dropped": low.cast("int"), "drop_reason": F.when(low, F.lit(LOW_SURPRISE))})


def string_list(c):
    """A JSON array of strings as an array; broken JSON and null as an empty one."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def to_embed(concepts: DataFrame, model: str) -> DataFrame:
    """Kept concepts without a vector of the current model."""
    stale = F.col("embedding").isNull() | F.col("embedding_model").isNull() | (F.col("embedding_model") != model)
    return concepts.where((F.col("dropped") == 0) & F.col("enriched_at").isNotNull() & stale)


def to_enrich(concepts: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    todo = concepts if force else concepts.where("enriched_at is null")
    return todo.orderBy("id").limit(limit) if limit is not None else todo


def valid(df: DataFrame) -> DataFrame:
    """``df`` with ``valid``: lengths, closed vocabularies and ranges of an enriched record; null is invalid."""
    def within(c, allowed):
        return F.size(c).between(1, 3) & (F.size(F.array_except(c, F.array(*map(F.lit, allowed)))) == 0)

    one = F.trim(F.regexp_replace("one_liner", r"\s+", " "))
    ok = (
        (F.length(one) <= 180) & F.length("aha_explanation").between(60, 900) & F.length("canonical_example").between(10, 600)
        & within(F.col("domain"), DOMAINS) & F.col("form").isin(*FORMS) & within(F.col("affect"), AFFECTS)
        & F.col("obscurity").between(1, 5) & F.col("surprise_score").between(1, 10) & (F.size(string_list(F.col("prerequisites_raw"))) <= 5)
    )
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


def cache_split(todo: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses): a cached row that isn't valid counts as a miss."""
    good = cache.where("valid").drop("valid")
    return todo.join(good, key), todo.join(good, key, "left_anti")


def lacking(concepts: DataFrame, quotes: DataFrame) -> DataFrame:
    """Concepts without a quote."""
    return concepts.join(quotes.select(F.col("concept_id").alias("id")).where("id is not null").distinct(), "id", "left_anti")


def first_wins(df: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """One row a key, that of the least ``priority``; combined on the map side, so no key is one task's work."""
    rest = [c for c in df.columns if c not in keys and c != priority]
    return df.groupBy(*keys).agg(F.min(F.struct(priority, *rest)).alias("_r")).select(*keys, "_r.*")


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """``existing`` and those of ``rows`` whose key it lacks, the first by ``priority``."""
    new = first_wins(rows, keys, priority).join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def put_latest(cache: DataFrame, rows: DataFrame, key: str = "key", at: str = "created_at") -> DataFrame:
    """A keyed table in which the last write wins."""
    both = cache.unionByName(rows)
    rest = [c for c in both.columns if c not in (key, at)]
    return both.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_r")).select(key, "_r.*")


def update_by_id(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with the values of ``changes``, one row a key at most; null and '' change nothing."""
    cols = [c for c in changes.columns if c != key]
    j = df.alias("d").join(changes.alias("c"), key, "left")
    types = dict(df.dtypes)
    new = {c: F.coalesce(F.nullif(F.col(f"c.{c}"), F.lit("")) if types[c] == "string" else F.col(f"c.{c}"), F.col(f"d.{c}")).alias(c) for c in cols}
    return j.select(*[new.get(c, F.col(c) if c == key else F.col(f"d.{c}")) for c in df.columns])


def resolve_aliases(titles: DataFrame, normalized: DataFrame, redirects: DataFrame, pages: DataFrame, most: int = 8) -> DataFrame:
    """(title, page columns): requested titles by way of normalised forms and redirects (from, to) to pages
    (page_title, ...); titles of missing pages are dropped. Redirects are followed to their end, at most
    ``most`` times, so that a loop ends."""
    t = titles.select("title", F.col("title").alias("at")).distinct()

    def hop(df, table):
        h = table.groupBy("from").agg(F.first("to").alias("to"))
        return df.join(h, F.col("at") == F.col("from"), "left").select("title", F.coalesce("to", "at").alias("at"))

    t = hop(t, normalized)
    for _ in range(most):
        nxt = hop(t, redirects)
        if nxt.exceptAll(t).isEmpty():
            break
        t = nxt
    return t.join(pages, F.col("at") == F.col("page_title")).drop("at")


def quotes_waterfall(quotes: DataFrame, order: tuple[str, ...] = ("wikiquote", "llm_verified"), cap: int = 3) -> DataFrame:
    """(concept_id, place, text, source): at most ``cap`` quotes of a concept, all of the first source of
    ``order`` that has any for it; place counts from 0 by rank, then id."""
    prio = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    q = quotes.withColumn("prio", prio).where("prio > 0")
    best = q.groupBy("concept_id").agg(F.min("prio").alias("best"))
    q = q.join(best, "concept_id").where("prio = best")
    w = Window.partitionBy("concept_id").orderBy("rank", "id")
    return q.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < cap).select("concept_id", "place", "text", "source")


def verified_quotes(quotes: DataFrame, evidence: DataFrame, phrase) -> DataFrame:
    """``quotes`` (id, text) with the first evidence page (site_order, page_title, body) that holds the phrase
    built by ``phrase``, which may end amid words of the page; (id, site_order, page_title).

    A page that holds a phrase has all tokens between the phrase's first and last blank as tokens of its own, so
    candidates meet by one of them: the one in the fewest pages. Only tokens that some phrase asks for leave a page,
    without its text; texts are brought to the candidates in the end. Phrases have three words at least; null ones
    and null bodies match nothing."""
    p = quotes.select("id", F.lower(phrase).alias("p")).where("p is not null")
    tokens = F.split("p", " ")
    inner = p.select("id", "p", F.explode(F.array_distinct(F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0))))).alias("w"))
    pages = evidence.where("body is not null").select("site_order", "page_title", F.lower("body").alias("body"))
    asked = pages.select("site_order", "page_title", F.explode(F.array_distinct(F.split("body", " "))).alias("w")).join(inner.select("w").distinct(), "w", "left_semi")
    in_pages = asked.groupBy("w").agg(F.count("*").alias("pages"))
    rarest = inner.join(in_pages, "w").groupBy("id", "p").agg(F.min(F.struct("pages", "w"))["w"].alias("w"))
    met = rarest.join(asked, "w").select("id", "p", "site_order", "page_title").distinct()
    hit = met.join(pages, ["site_order", "page_title"]).where("contains(body, p)")
    return hit.groupBy("id").agg(F.min(F.struct("site_order", "page_title")).alias("h")).select("id", "h.*")


def checked_quotes(quotes: DataFrame, cache: DataFrame, evidence: DataFrame, phrase) -> DataFrame:
    """(key, site_order, page_title) of each distinct text of ``quotes`` (id, text): out of ``cache`` (of the same
    columns) where it was checked before, whether found or not, else as it is found now. Texts found nowhere have
    nulls, and so aren't looked for again."""
    t = quotes.where("text is not null").select(F.sha2("text", 256).alias("key"), "text").distinct()
    new = t.join(cache.select("key"), "key", "left_anti").select(F.col("key").alias("id"), "text")
    hits = verified_quotes(new, evidence, phrase).withColumnRenamed("id", "key")
    return cache.select("key", "site_order", "page_title").unionByName(new.select(F.col("id").alias("key")).join(hits, "key", "left"))


def replaced_edges(existing: DataFrame, made: DataFrame, sources: list[str]) -> DataFrame:
    """Edges (src_id, dst_id, kind, source, weight, note) after a rebuild: those of ``sources`` are dropped, then the
    made ones are added, the first by source, then weight, of each (src_id, dst_id, kind); kept ones win."""
    keys, cols = ["src_id", "dst_id", "kind"], ["src_id", "dst_id", "kind", "source", "weight", "note"]
    old = existing.where(~F.coalesce(F.col("source").isin(*sources), F.lit(False))).select(*cols)
    new = made.groupBy(*keys).agg(F.min(F.struct("source", (-F.col("weight")).alias("w"), "note")).alias("m")).select(*keys, "m.source", (-F.col("m.w")).alias("weight"), "m.note")
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def nested_edges(edges: DataFrame) -> DataFrame:
    """(src, kinds: map of kind to list of {id, w}), lists heaviest first. A hub's list is one cell by nature of
    the format; queries use the flat edges."""
    e = edges.groupBy("src", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), F.col("dst").alias("id")))), lambda x: F.struct(x["id"].alias("id"), (-x["o"]).alias("w"))).alias("l"))
    return e.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("kind", "l"))).alias("kinds"))


def parse_final(c) -> tuple:
    """(framing, picks) columns from a reply: what is between the tags, picks as a list of {slug, why}; null if
    absent or broken."""
    framing = F.nullif(F.trim(F.regexp_extract(c, r"(?s)<framing>(.*?)</framing>", 1)), F.lit(""))
    picks = F.from_json(F.regexp_extract(c, r"(?s)<picks>\s*(\[.*?\])\s*</picks>", 1), "array<struct<slug:string,why:string>>")
    return framing, picks
