"""Evaluation items made from recorded facts, drawn into sets by quotas, and held against the collection they speak of.

A pool is four tables, so that an item may have any number of sources: a topic that a third of all documents mention is rows, not
an array.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdoc.functions.text import squeeze
from sparrowdoc.operators.places import placed
from sparrowdoc.operators.retrieve import holding
from sparrowdoc.sources.shared import Workspace

TYPES = ("fact", "decision", "open_discussion", "term", "cross_doc", "time_filter", "no_answer")
#: Drawn by a hash; the other types are taken in the order of their questions.
DRAWN = ("fact", "decision", "open_discussion")
MOST_POINTS = 8
#: What a core and a full set hold of each type, which kinds of facts come first, and what every set needs.
CORE = {"fact": 12, "decision": 10, "open_discussion": 8, "term": 5, "cross_doc": 15, "time_filter": 16, "no_answer": 8}
FULL = {"fact": 70, "decision": 46, "open_discussion": 30, "term": 5, "cross_doc": 15, "time_filter": 24, "no_answer": 8}
FLOORS = {"table": 2, "fragmented": 1, "long": 2, "scan": 1}
LEAST = {"cross_doc": 15, "time_filter": 15}


@dataclass(frozen=True)
class Wording:
    """Questions and answers: %1$s is the topic, the others are named beside each."""

    fact: str = "What does %2$s say of %1$s?"  # the title
    table: str = "What does the table of %2$s have for %3$s of %1$s?"  # the title, the row
    decision: str = "What was settled about %1$s in %2$s?"  # the title
    overturned: str = "What is the latest decision about %1$s in %2$s?"  # the title
    open_discussion: str = "Was anything settled about %1$s in %2$s?"  # the title
    term: str = "Which code stands for %1$s?"
    person: str = "What was decided about %1$s over time?"
    topic: str = "What do the documents say about %1$s?"
    year: str = "What happened with %1$s in %2$s?"  # the year
    no_answer: str = "What are the rules for %1$s?"
    undecided: str = "no decision"
    refusal: str = "Not covered by any document."
    ends: str = "."


@dataclass(frozen=True)
class Pool:
    """items (item_id, type, kind, anchor, question, expected_answer, refusable), phrases (item_id, phrase: in the answer, or, if the
    item has none, in no document), sources (item_id, doc_id), points (item_id, no, doc_id, phrase: key points)."""

    items: DataFrame
    phrases: DataFrame
    sources: DataFrame
    points: DataFrame

    def of(self, ids: DataFrame) -> Pool:
        """The items of ids (item_id, new_id), under their new ids."""
        own = lambda rows: rows.join(ids, "item_id").withColumn("item_id", F.col("new_id")).drop("new_id")
        return Pool(own(self.items), own(self.phrases), own(self.sources), own(self.points)).kept()

    def kept(self) -> Pool:
        """The pool as four written tables, so that checks do not make it again."""
        keep = Workspace(self.items.sparkSession).keep
        return Pool(keep(self.items), keep(self.phrases), keep(self.sources), keep(self.points))


def _items(rows: DataFrame, kind_of: str, wording: Column, answer: Column, kind: Column | None = None, anchor: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("item_id", F.lit(kind_of).alias("type"), (none if kind is None else kind).alias("kind"), (none if anchor is None else anchor).alias("anchor"), wording.alias("question"), answer.alias("expected_answer"), F.lit(kind_of == "no_answer").alias("refusable"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def build(facts: DataFrame, codes: DataFrame, series: DataFrame, absent: DataFrame, docs: DataFrame, words: Wording = Wording()) -> Pool:
    """All items that recorded facts allow.

    facts: doc_id, fact_no, title, topic, status (decided, overturned or open), key (a string of the text), text, kind, row (in a
    table, else NULL), year. codes: topic, code. series: topic, owner, doc_id. absent: term. docs: doc_id (a key), text.

    Facts that are not open go in turn to facts and decisions, so that no two items ask for one. Codes and the topic that most
    documents outside a series decide have all documents that mention them as sources. The tables are written before this returns.
    A NULL text holds nothing. Empty inputs give no items of their types.
    """
    sentence = F.substring(F.substring_index("text", words.ends, 1), 1, 60)
    named = facts.withColumn("point", sentence)
    one = lambda kind, *cols: F.concat_ws(":", F.lit(kind), *cols)
    settled = placed(named.where("status <> 'open'"), ["doc_id", "fact_no"], "at")
    fact = settled.where("at % 2 = 0").withColumn("item_id", one("fact", "doc_id", "fact_no"))
    decision = settled.where("at % 2 = 1").withColumn("item_id", one("decision", "doc_id", "fact_no"))
    undecided = named.where("status = 'open'").withColumn("item_id", one("open_discussion", "doc_id", "fact_no"))
    says = lambda text, *cols: F.format_string(text, *(F.col(c).cast("string") for c in cols))
    asked = F.when(F.col("row").isNull(), says(words.fact, "topic", "title")).otherwise(says(words.table, "topic", "title", "row"))
    settles = F.when(F.col("status") == "overturned", says(words.overturned, "topic", "title")).otherwise(says(words.decision, "topic", "title"))

    term = codes.dropDuplicates(["code"]).withColumn("item_id", one("term", "code"))
    own = series.select("topic", "owner", "doc_id").distinct()
    person = own.groupBy("topic").agg(F.min("owner").alias("owner")).withColumn("item_id", one("cross_doc", "topic"))
    ordinary = named.where("status = 'decided'").join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    wide = ordinary.groupBy("topic").agg(F.countDistinct("doc_id").alias("n")).where("n > 1").orderBy(F.desc("n"), "topic").limit(1)
    wide = wide.select("topic", one("cross_doc", F.lit("topic"), "topic").alias("item_id"))
    dated = own.join(named.select("doc_id", "year").distinct(), "doc_id").groupBy("topic", "year").agg(F.min_by(F.struct("owner", "doc_id"), "doc_id").alias("d"))
    dated = dated.select("topic", "year", "d.*", one("time_filter", "topic", "year").alias("item_id"))
    nowhere = absent.dropDuplicates(["term"]).withColumn("item_id", one("no_answer", "term"))

    items = [
        _items(fact, "fact", asked, F.col("key"), kind=F.coalesce("kind", F.lit("ordinary"))),
        _items(decision, "decision", settles, F.col("key")),
        _items(undecided, "open_discussion", says(words.open_discussion, "topic", "title"), F.lit(words.undecided)),
        _items(term, "term", says(words.term, "topic"), F.col("code")),
        _items(person, "cross_doc", says(words.person, "topic"), F.col("owner"), anchor=F.lit("person")),
        _items(wide, "cross_doc", says(words.topic, "topic"), F.col("topic"), anchor=F.lit("topic")),
        _items(dated, "time_filter", says(words.year, "topic", "year"), F.concat_ws(", ", "owner", "year")),
        _items(nowhere, "no_answer", says(words.no_answer, "term"), F.lit(words.refusal)),
    ]
    said = lambda rows, *cols: rows.select("item_id", F.explode(F.array(*(F.col(c).cast("string") if isinstance(c, str) else c for c in cols))).alias("phrase")).where("phrase is not null")
    phrases = [said(fact, "row", "key"), said(decision, "key"), said(undecided, F.lit(words.undecided)), said(term, "code"), said(person, "owner"), said(wide, "topic"), said(dated, "owner", "year"), said(nowhere, "term")]

    mentions = term.select("item_id", squeeze("code").alias("form")).union(wide.select("item_id", squeeze("topic").alias("form")))
    met = holding(docs.select("doc_id", squeeze("text").alias("t")), mentions, "doc_id", "t", "form").join(mentions, "form")
    sources = [*(rows.select("item_id", "doc_id") for rows in (fact, decision, undecided, dated)), person.join(own, "topic").select("item_id", "doc_id"), met.select("item_id", "doc_id")]

    first = lambda rows: rows.groupBy("item_id", "doc_id").agg(F.min_by("point", "fact_no").alias("phrase"))
    of_series = person.select("item_id", "topic").join(own, "topic").select("item_id", "doc_id").join(named, "doc_id")
    of_topic = wide.join(named, "topic").join(ordinary.select("doc_id", "topic").distinct(), ["doc_id", "topic"], "left_semi")
    of_year = dated.select("item_id", "topic", "doc_id").join(named, ["doc_id", "topic"]).select("item_id", "doc_id", "fact_no", F.col("point").alias("phrase"))
    points = _union([first(of_series).withColumn("fact_no", F.lit(0)), first(of_topic).withColumn("fact_no", F.lit(0)), of_year])
    number = F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id", "fact_no"))
    points = points.withColumn("no", number).where(F.col("no") <= MOST_POINTS).select("item_id", "no", "doc_id", "phrase")
    return Pool(_union(items), _union(phrases).distinct(), _union(sources).distinct(), points).kept()


def drawn(pool: Pool, quotas: dict[str, int], prefix: str = "q", seed: int = 42, floors: dict[str, int] = FLOORS) -> Pool:
    """A set of at most a quota of each type, numbered by type and place: facts of the kinds in floors first, then by SHA-256 of seed
    and id; types outside DRAWN by question. A set of larger quotas holds the items of a smaller one, with the same seed and floors.

    Ranks within types are limited in each task, and only as many rows as the quotas have are numbered together.
    """
    types = F.array(*map(F.lit, TYPES))
    order = F.when(F.col("type").isin(*DRAWN), F.sha2(F.concat_ws("|", F.lit(str(seed)), "item_id"), 256)).otherwise(F.col("question"))
    rows = pool.items.where(F.col("type").isin(*quotas)).select("item_id", "type", "kind", order.alias("o"))
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("o", "item_id"))
    most = max(quotas.values(), default=0)
    near = rows.withColumn("c", number("type")).where(F.col("c") <= most).withColumn("late", F.lit(1))
    if floors:
        floor = F.element_at(F.create_map(*(F.lit(x) for pair in floors.items() for x in pair)), F.col("kind"))
        early = rows.where((F.col("type") == "fact") & F.col("kind").isin(*floors)).withColumn("c", number("kind"))
        early = early.where(F.col("c") <= max(floors.values())).where(F.col("c") <= floor).withColumn("late", F.lit(0))
        near = near.unionByName(early).groupBy("item_id", "type", "o").agg(F.min("late").alias("late"))
    quota = F.element_at(F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair)), F.col("type"))
    place = F.row_number().over(Window.partitionBy("type").orderBy("late", "o", "item_id"))
    taken = near.withColumn("place", place).where(F.col("place") <= quota).withColumn("t", F.array_position(types, F.col("type")))
    numbered = taken.withColumn("n", F.row_number().over(Window.orderBy("t", "place")))  # as many rows as the quotas have
    return pool.of(numbered.select("item_id", F.format_string(f"{prefix}%03d", "n").alias("new_id")))


def violations(pool: Pool, docs: DataFrame, chunks: DataFrame, scanned: DataFrame | None = None, least: dict[str, int] = LEAST) -> DataFrame:
    """check, item_id, phrase, doc_id, n: what a pool or set does not keep to. White space does not count in any comparison.

    unknown source: a source is no document; nothing else is said of such an item. no source: an item to be answered has none.
    not in text: no source has a phrase, or its document has no such key point. not in chunks: no chunk of a source has it, so that no
    search can find it. found elsewhere: the phrase of an item without an answer is in a document, or a person is in one outside
    the sources, or a topic in a document outside them or not in one of them. points: an item over several documents has none or
    more than MOST_POINTS. too few: of a type (in item_id). repeated id. to be read: all sources are in scanned (doc_id), whose texts come later;
    no phrase of these is checked. doc_id is the smallest of n documents, where there are any.

    docs: doc_id (a key), text; chunks: doc_id, text. Each check is a join on document or item, or a lookup of phrases by hash; no
    item's phrases or sources are gathered. What several checks read is written once, before this returns.
    """
    keep = Workspace(docs.sparkSession).keep
    texts = docs.select("doc_id", squeeze("text").alias("t"))
    out = []

    def report(check: str, rows: DataFrame, phrase: str | None = None, doc: str | None = None) -> None:
        by = ["item_id", *([phrase] if phrase else [])]
        found = rows.groupBy(*by).agg((F.min(doc) if doc else F.lit(None).cast(docs.schema["doc_id"].dataType)).alias("doc_id"), F.count("*").alias("n"))
        out.append(found.select(F.lit(check).alias("check"), "item_id", (F.col(phrase) if phrase else F.lit(None).cast("string")).alias("phrase"), "doc_id", "n"))

    named = pool.sources.unionByName(pool.points.select("item_id", "doc_id")).distinct()
    unknown = keep(named.join(docs.select("doc_id"), "doc_id", "left_anti"))
    report("unknown source", unknown, doc="doc_id")
    sound = keep(pool.items.select("item_id", "type", "anchor").distinct().join(unknown.select("item_id").distinct(), "item_id", "left_anti"))
    answered = sound.where("type <> 'no_answer'")
    sources = keep(pool.sources.join(answered.select("item_id"), "item_id", "left_semi"))
    report("no source", answered.join(sources, "item_id", "left_anti"))
    if scanned is not None:
        read = sources.join(scanned.select("doc_id").distinct(), "doc_id", "left_anti").select("item_id").distinct()
        later = keep(sources.select("item_id").distinct().join(read, "item_id", "left_anti"))
        report("to be read", later)
        answered = answered.join(later, "item_id", "left_anti")
        sources = sources.join(later, "item_id", "left_anti")

    wanted = pool.phrases.join(sources, "item_id").select("item_id", "phrase", "doc_id", F.lit(False).alias("point"))
    points = pool.points.join(answered.select("item_id"), "item_id", "left_semi")
    wanted = keep(wanted.unionByName(points.select("item_id", "phrase", "doc_id", F.lit(True).alias("point"))).withColumn("form", squeeze("phrase")))
    for check, rows in (("not in text", texts), ("not in chunks", chunks.select("doc_id", squeeze("text").alias("t")))):
        met = keep(wanted.join(rows, "doc_id").where(F.contains("t", "form")).select("item_id", "phrase", "doc_id", "point").distinct())
        missed = wanted.where("point").join(met.where("point"), ["item_id", "phrase", "doc_id"], "left_anti").select("item_id", "phrase", "doc_id")
        never = wanted.where("not point").join(met.where("not point").select("item_id", "phrase").distinct(), ["item_id", "phrase"], "left_anti").select("item_id", "phrase", "doc_id")
        report(check, missed.union(never).distinct(), "phrase", "doc_id")

    anchors = pool.items.where("anchor is not null").select("item_id", "anchor", F.col("expected_answer").alias("phrase")).join(answered.select("item_id"), "item_id", "left_semi")
    nowhere = pool.phrases.join(sound.where("type = 'no_answer'").select("item_id"), "item_id", "left_semi").withColumn("anchor", F.lit("nowhere"))
    looked = keep(anchors.unionByName(nowhere).withColumn("form", squeeze("phrase")))
    met = keep(holding(texts, looked, "doc_id", "t", "form").join(looked, "form").select("item_id", "anchor", "phrase", "doc_id").distinct())
    strays = met.join(pool.sources, ["item_id", "doc_id"], "left_anti")
    lacking = looked.where("anchor = 'topic'").join(pool.sources, "item_id").select("item_id", "anchor", "phrase", "doc_id").join(met, ["item_id", "phrase", "doc_id"], "left_anti")
    report("found elsewhere", strays.unionByName(lacking.select(*strays.columns)), "phrase", "doc_id")

    several = sound.where(F.col("type").isin("cross_doc", "time_filter"))
    counts = several.join(pool.points.groupBy("item_id").agg(F.count("*").alias("k")), "item_id", "left")
    report("points", counts.where((F.coalesce("k", F.lit(0)) < 1) | (F.col("k") > MOST_POINTS)))
    out.append(pool.items.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated id").alias("check"), "item_id", F.lit(None).cast("string").alias("phrase"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n"))
    if least:
        wanting = docs.sparkSession.createDataFrame(sorted(least.items()), "item_id string, least long")
        have = pool.items.groupBy(F.col("type").alias("item_id")).agg(F.count("*").alias("n"))
        few = wanting.join(have, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where("n < least")
        out.append(few.select(F.lit("too few").alias("check"), "item_id", F.lit(None).cast("string").alias("phrase"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n"))
    return _union(out)
