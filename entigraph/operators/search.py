"""Full-text search: postings, corpus statistics and BM25F, for one query or a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entigraph import scratch
from entigraph.functions.stem import stem_arrays, stem_column
from entigraph.functions.text import raw_tokens
from entigraph.scratch import stored

K1, B = 1.2, 0.75
Analyzer = Callable[[Column], Column]


def _text(rows: DataFrame, field: str) -> Column:
    """Arrays are joined by blanks."""
    return F.array_join(field, " ") if rows.schema[field].dataType.typeName() == "array" else F.col(field)


def analysed(rows: DataFrame, fields: Iterable[str], analyzer: Analyzer = raw_tokens, stem: bool = False) -> DataFrame:
    """(id, field, words, terms) with a row for every entity and field: its words in order, and the terms that stand for them (their stems)."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), analyzer(_text(rows, f)).alias("words")) for f in fields])
    out = rows.select("id", F.explode(each).alias("f")).select("id", "f.field", "f.words")
    return out.withColumn("terms", stem_arrays("words") if stem else F.col("words"))


def _placed(fields: DataFrame) -> DataFrame:
    """(id, field, pos, term, word) of analysed fields."""
    each = fields.select("id", "field", F.posexplode(F.arrays_zip("terms", "words")).alias("pos", "t"))
    return each.select("id", "field", "pos", F.col("t.terms").alias("term"), F.col("t.words").alias("word"))


def tokens(rows: DataFrame, fields: Iterable[str], analyzer: Analyzer = raw_tokens, stem: bool = False) -> DataFrame:
    """(id, field, pos, term)."""
    return _placed(analysed(rows, fields, analyzer, stem)).drop("word")


def stemmed(terms: DataFrame) -> DataFrame:
    """A table with a column term, its words stemmed in batches, where they are."""
    return terms.withColumn("term", stem_column("term"))


def postings(terms: DataFrame) -> DataFrame:
    """(id, field, term, tf)."""
    return terms.groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def field_lengths(rows: DataFrame, fields: Iterable[str], analyzer: Analyzer = raw_tokens) -> DataFrame:
    """(id, field, len) with a row for every entity and field, 0 for empty ones."""
    return analysed(rows, fields, analyzer).select("id", "field", F.size("words").alias("len"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    """(term, df): entities that have a term in any field."""
    return posted.groupBy("term").agg(F.countDistinct("id").alias("df"))


def average_lengths(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.avg("len").alias("avgdl"))


def _contributions(matched: DataFrame) -> DataFrame:
    """(query_id, id, term, df, idf, tilde_tf, contribution) of matched terms by field."""
    t = matched.groupBy("query_id", "id", "term", "df", "idf").agg(F.sum("wtf").alias("tilde_tf"))
    return t.withColumn("contribution", F.col("idf") * F.col("tilde_tf") / (K1 + F.col("tilde_tf")))


def _scores(explained: DataFrame) -> DataFrame:
    return explained.groupBy("query_id", "id").agg(F.sum("contribution").alias("score")).where("score > 0")


class Index:
    """What a class's searches share. Terms are stems, in texts, queries and conditions alike, unless stem is false.

    A query keeps of each text the terms that it asks for before anything is grouped or shuffled. Of a saved index it reads only its terms' postings, texts not at all."""

    def __init__(self, rows: DataFrame, weights: dict[str, float], analyzer: Analyzer = raw_tokens, stem: bool = True) -> None:
        if not weights:
            raise ValueError("no field weights: the class declares none and none were given")
        self.spark, self.rows, self.weights, self.analyzer, self.stem = rows.sparkSession, rows, dict(weights), analyzer, stem
        self.fields = analysed(rows, self.weights, analyzer, stem)
        self.terms = _placed(self.fields)
        self.postings = row_postings(rows, weights, analyzer, stem)
        self.lengths = field_lengths(rows, self.weights, analyzer)
        self.averages = average_lengths(self.lengths)
        self.n = rows.agg(F.countDistinct("id").alias("n_docs"))
        self.saved: DataFrame | None = None

    def analyse(self, texts: DataFrame, column: str) -> DataFrame:
        """texts with their column as the array of its terms."""
        out = texts.withColumn(column, self.analyzer(F.col(column)))
        return out.withColumn(column, stem_arrays(column)) if self.stem else out

    def terms_of(self, texts: Iterable[str]) -> list[list[str]]:
        """The terms of a few texts that a caller gives."""
        if not (rows := list(enumerate(texts))):
            return []
        got = self.analyse(self.spark.createDataFrame(rows, "i int, t string"), "t").collect()
        return [list(r.t) for r in sorted(got)]

    def queries(self, query) -> DataFrame:
        """(query_id, term), distinct, from a text or a DataFrame (query_id, query)."""
        if isinstance(query, str):
            return self._asked(sorted(set(self.terms_of([query])[0])))
        return self.analyse(query.select("query_id", "query"), "query").select("query_id", F.explode("query").alias("term")).distinct()

    def _asked(self, terms: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(0, t) for t in terms], "query_id int, term string")

    def _hits(self, asked: DataFrame, terms: list[str] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(id, field, term, tf, len) of the terms asked for, average lengths, and the number of entities. For the terms of one text, a list, texts are read once:
        each row's terms are cut to these where they are, and kept with its length."""
        if self.saved is not None:
            some = self.saved if terms is None else self.saved.where(F.col("term").isin(terms))
            out = some.join(asked, "term", "left_semi").groupBy("id", "field", "term").agg(F.sum(F.size("positions")).alias("tf"), F.first("len").alias("len"))
            return stored(out, "search-hits"), self.averages, self.n
        lengths = self.fields.select("id", "field", F.size("terms").alias("len"), "terms")
        if terms is None:
            each = lengths.select("id", "field", "len", F.explode("terms").alias("term")).join(asked, "term", "left_semi")
            return stored(each.groupBy("id", "field", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len")), "search-hits"), self.averages, self.n
        rows = stored(lengths.withColumn("terms", F.filter("terms", lambda t: t.isin(terms))), "search-rows")
        out = rows.select("id", "field", "len", F.explode("terms").alias("term")).groupBy("id", "field", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
        return out, average_lengths(rows), rows.agg(F.countDistinct("id").alias("n_docs"))

    def _found(self, query) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(query_id, term) of the queries, and _hits() of their terms."""
        terms = sorted(set(self.terms_of([query])[0])) if isinstance(query, str) else None
        asked = stored(self.queries(query), "search-terms") if terms is None else self._asked(terms)
        if terms is None and len(few := asked.select("term").distinct().limit(FEW + 1).collect()) <= FEW:
            terms = sorted(r.term for r in few)
        return asked, *self._hits(asked.select("term").distinct(), terms)

    def _weighed(self, hit: DataFrame, df: DataFrame, averages: DataFrame, n: DataFrame, weights: dict[str, float] | None) -> DataFrame:
        """(id, field, term, df, wtf, idf): the weighted, length-normalised frequency of each term asked for in each field."""
        weights = weights or self.weights
        w = F.create_map(*[x for f, v in weights.items() for x in (F.lit(f), F.lit(float(v)))])
        out = hit.join(df, "term").join(averages, "field").crossJoin(n)
        norm = F.when(F.col("avgdl") > 0, 1 - B + B * F.col("len") / F.col("avgdl")).otherwise(1.0)
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return out.withColumn("weight", w[F.col("field")]).where("weight is not null").select("id", "field", "term", "df", (F.col("weight") * F.col("tf") / norm).alias("wtf"), idf.alias("idf"))

    def _matched(self, query, weights: dict[str, float] | None) -> DataFrame:
        """(query_id, id, field, term, df, wtf, idf)."""
        asked, hit, averages, n = self._found(query)
        out = self._weighed(hit, document_frequencies(hit), averages, n, weights)
        return out.join(asked, "term").select("query_id", "id", "field", "term", "df", "wtf", "idf")

    def explain(self, query, weights: dict[str, float] | None = None) -> DataFrame:
        """(query_id, id, term, df, idf, tilde_tf, contribution); contributions sum to the score."""
        return _contributions(self._matched(query, weights))

    def score(self, query, weights: dict[str, float] | None = None, where: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score) of entities with a score above 0; where (id) narrows them, not the statistics."""
        out = _scores(self.explain(query, weights))
        return out if where is None else out.join(where.select("id"), "id", "left_semi").select("query_id", "id", "score")

    def top(self, query, limit: int, weights: dict[str, float] | None = None, digits: int = 9) -> DataFrame:
        """(query_id, id, score, rank): the first `limit` entities of each query by score, rounded to `digits`, and id, as best(score(query), limit) has them.

        Queries of the same terms have one answer. Entities that have the terms asked for equally often, in fields of equal lengths, have one score, and only the first `limit` of such can be among
        the first of all: scores are made for one of each kind, and the kinds that lead are expanded."""
        asked, hit, averages, n = self._found(query)
        sets = stored(asked.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("terms")), "search-queries")
        kinds = stored(sets.groupBy("terms").agg(F.min("query_id").alias("kind")), "search-kinds")
        has = hit.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "field", "tf", "len"))).alias("has"))
        alike = Window.partitionBy(F.xxhash64("has"), "has").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ids = stored(has.select("id", "has", F.row_number().over(alike).alias("place"), F.first("id").over(alike).alias("head")).where(F.col("place") <= limit), "search-alike")
        one = ids.where("place = 1").select("id", F.explode("has").alias("h")).select("id", "h.*")
        weighed = self._weighed(one, document_frequencies(hit), averages, n, weights)
        scores = _scores(_contributions(weighed.join(kinds.select(F.col("kind").alias("query_id"), F.explode("terms").alias("term")), "term")))
        # a kind that comes behind `limit` others, by its first id, has none of the first entities
        led = stored(best(scores.withColumn("score", F.round("score", digits)), limit).select("query_id", F.col("id").alias("head"), "score"), "search-led")
        first = best(led.join(ids.select("id", "head"), "head").select("query_id", "id", "score"), limit).withColumnRenamed("query_id", "kind")
        return sets.join(kinds, "terms").select("query_id", "kind").join(first, "kind").select("query_id", "id", "score", "rank")

    def field_scores(self, query, weights: dict[str, float] | None = None) -> DataFrame:
        """(query_id, id, field, score): as if each field were the only one."""
        m = self._matched(query, weights).withColumn("c", F.col("idf") * F.col("wtf") / (K1 + F.col("wtf")))
        return m.groupBy("query_id", "id", "field").agg(F.sum("c").alias("score"))

    def save(self, path: str) -> None:
        """The first segment of an index at path (see append); an index that is there already is added to."""
        append(self.rows, path, self.weights, self.analyzer, self.stem)

    def load(self, path: str) -> Index:
        """From here on what lies at path is read, instead of the texts."""
        spark = self.spark
        read = lambda what: spark.read.parquet(f"{path}/{what}")
        gone = _tombstones(spark, path)

        def live(df: DataFrame) -> DataFrame:
            if gone is None:
                return df.drop("segment")
            dead = gone.groupBy(F.col("id").alias("dead")).agg(F.max("segment").alias("until"))
            return df.join(dead, (F.col("id") == F.col("dead")) & (F.col("segment") <= F.col("until")), "left_anti").drop("segment")

        self.path, self.saved, self.lengths = path, live(read("postings")), live(read("lengths"))
        # counts of segments, less those of what was retracted
        counts = read("stats").select("field", "rows", "total", "docs")
        if gone is not None:
            counts = counts.union(gone.groupBy("field", "segment", "id").agg(F.count("*").alias("rows"), F.sum("len").alias("total")).groupBy("field").agg(-F.sum("rows"), -F.sum("total"), -F.countDistinct("id", "segment")))
        counts = counts.groupBy("field").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.sum("docs").alias("docs"))
        self.averages = counts.select("field", (F.col("total") / F.nullif("rows", F.lit(0))).alias("avgdl"))
        self.n = counts.agg(F.coalesce(F.max("docs"), F.lit(0)).alias("n_docs"))
        self.terms = self.saved.select("id", "field", F.explode("positions").alias("pos"), "term", "word")
        self.postings = self.saved.groupBy("id", "field", "term").agg(F.sum(F.size("positions")).alias("tf"))
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str, weights: dict[str, float], analyzer: Analyzer = raw_tokens, stem: bool = True) -> Index:
        """The index at path, without the rows that it was made of."""
        self = cls.__new__(cls)
        self.spark, self.rows, self.weights, self.analyzer, self.stem = spark, None, dict(weights), analyzer, stem
        return self.load(path)

    def ids(self) -> DataFrame:
        return (self.rows if self.saved is None else self.lengths).select("id").distinct()

    def lexicon(self) -> DataFrame:
        """(word, term, n): distinct words, their terms, and how many postings they have (retracted ones may be counted)."""
        if self.saved is None:
            return self.terms.groupBy("word", "term").agg(F.count("*").alias("n"))
        return self.spark.read.parquet(f"{self.path}/lexicon").groupBy("word", "term").agg(F.sum("n").alias("n"))

    def words_like(self, prefix: str | None = None, fuzzy: str | None = None, distance: int = 2) -> DataFrame:
        """(word) of the lexicon with a prefix, or within an edit distance. In a saved index a prefix is a range of files in order of word, and words at a distance are those that share a
        variant, made by as many deletions, with the one asked for: an equality, then verified. Words beyond LONGEST_VARIED characters, and longer distances, go over the lexicon."""
        words = self.lexicon().select("word")
        if prefix is not None:
            return words.where(F.col("word").startswith(prefix)).distinct()
        near = F.levenshtein("word", F.lit(fuzzy), distance) >= 0
        if self.saved is None or distance > DELETIONS:
            return words.where(near).distinct()
        if (varied := _read(self.spark, f"{self.path}/variants")) is None:
            return words.where(near).distinct()
        shared = varied.where(F.col("variant").isin(sorted(_variants_of(fuzzy, distance)))).select("word")
        if len(fuzzy) + distance > LONGEST_VARIED:
            shared = shared.union(words.where(F.length("word") > LONGEST_VARIED))
        return shared.where(near).distinct()


#: Deletions that a lexicon's variants have, and the longest word that has variants.
DELETIONS, LONGEST_VARIED = 2, 40
#: Words or terms that are put into a filter; more are joined.
FEW = 1_000


def _variants_of(word: str, deletions: int) -> set[str]:
    out = {word}
    for _ in range(deletions):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def variants(words: DataFrame) -> DataFrame:
    """(variant, word) of each word (up to LONGEST_VARIED characters) and all that is left of it after up to DELETIONS deletions."""
    less = lambda w: F.transform(F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    every, last = F.array("word"), F.array("word")
    for _ in range(DELETIONS):
        last = F.array_distinct(F.flatten(F.transform(last, less)))
        every = F.concat(every, last)
    return words.where(F.length("word") <= LONGEST_VARIED).select(F.explode(F.array_distinct(every)).alias("variant"), "word")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """None if nothing is there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _tombstones(spark: SparkSession, path: str) -> DataFrame | None:
    return _read(spark, f"{path}/tombstones")


def _last_segment(spark: SparkSession, path: str) -> int:
    stats = _read(spark, f"{path}/stats")
    return -1 if stats is None else stats.agg(F.max("segment")).first()[0]


def _spread(rows: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Ids with their fields in four parts a core, but no more than there are shuffle partitions: many short texts can lie in one small file, which would be one task's."""
    spark, fields = rows.sparkSession, [f for f in dict.fromkeys(fields) if f != "id"]
    return rows.select("id", *fields).repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "id")


def _posted(fields: DataFrame, stem: bool) -> DataFrame:
    """(id, field, len, posted) of (id, field, words); posted has (term, word, positions) of each distinct word. A batch's words are numbered and sorted within it: none is moved to be counted."""
    kind = fields.schema["id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from entigraph.functions.stem import stem as stem_of

        for batch in batches:
            ids, field, words = batch.columns
            coded, size = words.flatten().dictionary_encode(), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row, code = np.repeat(np.arange(len(size)), size), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((code, row))  # stable: places stay in order
            row, code, pos = row[order], code[order], (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size))[order]
            new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
            known = coded.dictionary
            terms = pa.array([stem_of(w) for w in known.to_pylist()], pa.string()) if stem else known
            lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            places = lists(np.append(new, len(row)), pa.array(pos, pa.int32()))
            each = pa.StructArray.from_arrays([terms.take(pa.array(code[new])), known.take(pa.array(code[new])), places], ["term", "word", "positions"])
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(size)))))
            yield pa.RecordBatch.from_arrays([ids, field, pa.array(size, pa.int32()), lists(ends, each)], ["id", "field", "len", "posted"])

    return fields.select("id", "field", "words").mapInArrow(make, f"id {kind}, field string, len int, posted array<struct<term:string,word:string,positions:array<int>>>")


def row_postings(rows: DataFrame, fields: Iterable[str], analyzer: Analyzer = raw_tokens, stem: bool = False) -> DataFrame:
    """(id, field, term, tf), as postings() of all tokens: rows of one id come together as texts, and their terms are counted within that row, a batch of rows at once. No token is moved or grouped."""
    fields, kind = list(fields), rows.schema["id"].dataType.simpleString()
    of = lambda f: lambda r: analyzer(F.array_join(r[f], " ") if rows.schema[f].dataType.typeName() == "array" else r[f])
    once = _spread(rows, fields).groupBy("id").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.flatten(F.transform("rows", of(f))).alias("words")) for f in fields])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from entigraph.functions.stem import stem as stem_of

        for batch in batches:
            ids, field, words = batch.columns
            coded, size = words.flatten().dictionary_encode(), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms = pa.array([stem_of(w) for w in coded.dictionary.to_pylist()] if stem else coded.dictionary, pa.string()).dictionary_encode()
            term = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            n = max(len(terms.dictionary), 1)
            has, tf = np.unique(np.repeat(np.arange(len(size)), size) * n + term, return_counts=True)
            row = pa.array(has // n)
            yield pa.RecordBatch.from_arrays([ids.take(row), field.take(row), terms.dictionary.take(pa.array(has % n)), pa.array(tf.astype(np.int64))], ["id", "field", "term", "tf"])

    return once.select("id", F.explode(each).alias("f")).select("id", "f.field", "f.words").mapInArrow(make, f"id {kind}, field string, term string, tf long")


def term_counts(rows: DataFrame, fields: Iterable[str], analyzer: Analyzer = raw_tokens, stem: bool = False) -> DataFrame:
    """(term, n): how often each term occurs. Words are counted where they are read, and distinct ones stemmed."""
    fields = list(fields)
    words = analysed(rows, fields, analyzer).select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return stemmed(words).groupBy("term").agg(F.sum("n").alias("n")) if stem else words


def append(rows: DataFrame, path: str, weights: dict[str, float], analyzer: Analyzer = raw_tokens, stem: bool = True, varied: bool = True) -> None:
    """Adds rows to the index at path as a segment of its own; rows whose id it has take the place of the earlier ones. No earlier text or posting is read.

    A segment has postings in order of term, the lexicon in order of word, its variants in order, lengths and counts: a query's terms are found by the files' statistics.
    varied: without variants, about a hundred for a word of ten letters, words near a word are looked for in all of the lexicon."""
    spark, segment = rows.sparkSession, _last_segment(rows.sparkSession, path) + 1
    if segment:
        retract(rows.select("id").distinct(), path)
    fields = stored(_posted(analysed(_spread(rows, weights), weights, analyzer), stem), "index-fields")
    lengths = fields.select("id", "field", "len")
    posted = fields.select("id", "field", "len", F.explode("posted").alias("p")).select("id", "field", "p.term", "p.word", "len", "p.positions")
    at = lambda what: f"{path}/{what}/segment={segment}"
    posted.repartitionByRange("term", "id").sortWithinPartitions("term").write.parquet(at("postings"))
    lexicon = spark.read.parquet(at("postings")).groupBy("word", "term").agg(F.count("*").alias("n"))
    lexicon.repartitionByRange("word").sortWithinPartitions("word").write.parquet(at("lexicon"))
    if varied:
        variants(spark.read.parquet(at("lexicon")).select("word").distinct()).repartitionByRange("variant").sortWithinPartitions("variant").write.parquet(at("variants"))
    lengths.write.parquet(at("lengths"))
    # the counts come last: a segment without them is none
    lengths.groupBy("field").agg(F.count("*").alias("rows"), F.sum("len").cast("long").alias("total"), F.countDistinct("id").alias("docs")).write.parquet(at("stats"))


def retract(ids: DataFrame, path: str) -> None:
    """Takes entities (id) out of the index at path: their lengths are noted beside it, and nothing else is read or written."""
    spark, last = ids.sparkSession, _last_segment(ids.sparkSession, path)
    had = spark.read.parquet(f"{path}/lengths").join(ids.select("id").distinct(), "id", "left_semi")
    if (gone := _tombstones(spark, path)) is not None:
        dead = gone.groupBy(F.col("id").alias("dead")).agg(F.max("segment").alias("until"))
        had = had.join(dead, (F.col("id") == F.col("dead")) & (F.col("segment") <= F.col("until")), "left_anti")
    stored(had.select("id", "field", F.col("len").cast("int").alias("len"), F.lit(last).cast("int").alias("segment")), "retracted").write.mode("append").parquet(f"{path}/tombstones")


#: Paths of the indexes that kept_index() has made.
_KEPT: dict[tuple, str] = {}


def kept_index(rows: DataFrame, weights: dict[str, float], analyzer: Analyzer = raw_tokens, stem: bool = True, varied: bool = True) -> Index:
    """The index of rows that lie in files, saved in the scratch folder and opened again as long as the application runs and the files are the same (by path, length and time)."""
    spark, files = rows.sparkSession, []
    for f in rows.inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        files.append((f, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, tuple(sorted(files)), tuple(sorted(weights.items())), analyzer, stem, varied)
    if key not in _KEPT or scratch.is_open():
        path = scratch.new_path(spark, "index")
        append(rows, path, weights, analyzer, stem, varied)
        if scratch.is_open():  # it will be cleared
            return Index.open(spark, path, weights, analyzer, stem)
        _KEPT[key] = path
    return Index.open(spark, _KEPT[key], weights, analyzer, stem)


def best(scores: DataFrame, limit: int) -> DataFrame:
    """The first `limit` hits of each query (0: all), with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = scores.withColumn("rank", rank)
    return out.where(F.col("rank") <= limit) if limit else out


def snippet(text: Column, query: str, width: int = 120) -> Column:
    """The text around the first word of a query, each word marked by `**`; null if none occurs."""
    import re

    words = list(dict.fromkeys(w for w in re.split(r"\s+", query.lower().strip()) if w))
    if not words:
        return F.lit(None).cast("string")
    low = F.lower(text)
    places = [F.when(F.instr(low, w) > 0, F.instr(low, w)) for w in words]
    at = F.least(*places) if len(places) > 1 else places[0]
    first = F.greatest(at - width, F.lit(1))
    last = F.least(at - 1 + width, F.length(text))
    out = text.substr(first, last - first + 1)
    for w in words:
        out = F.regexp_replace(out, f"(?i)\\Q{w}\\E", r"**$0**")
    marked = F.concat(F.when(first > 1, "...").otherwise(""), out, F.when(last < F.length(text), "...").otherwise(""))
    return F.when(at.isNotNull(), marked)


def field_index(rows: DataFrame, field: str, fulltext: Iterable[str], stem: bool = False, **more) -> Index:
    """Over one full-text slot, its words as they are; other slots are refused."""
    if field not in set(fulltext):
        raise ValueError(f"{field} is no full-text slot")
    return Index(rows, {field: 1.0}, stem=stem, **more)


def matching(index: Index, all_of: Iterable[str] = (), any_of: Iterable[str] = (), none_of: Iterable[str] = (), phrase: str | None = None, prefix: str | None = None, fuzzy: str | None = None, distance: int = 2) -> DataFrame:
    """(id) of entities that meet all the conditions given. Conditions are analysed as texts are: one of several words asks for each of them. prefix and fuzzy, lower-cased, are held against words, not stems.

    Words with a prefix or near a word are looked up in the lexicon; then one pass over the postings of all that is asked for answers every condition but the phrase."""
    all_of, any_of, none_of = (list(dict.fromkeys(t for words in index.terms_of(x) for t in words)) for x in (all_of, any_of, none_of))
    term, word = F.col("term"), F.col("word")
    posted = index.terms if index.saved is None else index.saved
    tests = [term.isin(x) for x in (all_of, any_of, none_of) if x]
    needs = []  # of an entity's postings
    if all_of:
        needs.append(F.count_distinct(F.when(term.isin(all_of), term)) == len(all_of))
    if any_of:
        needs.append(F.max(term.isin(any_of)))
    if none_of:
        needs.append(~F.max(term.isin(none_of)))
    for name, asked in (("prefix", prefix), ("fuzzy", fuzzy)):
        if not asked:
            continue
        like = index.words_like(prefix=asked.lower()) if name == "prefix" else index.words_like(fuzzy=asked.lower(), distance=distance)
        if index.saved is None:  # its lexicon would be made of the same texts
            test = word.startswith(asked.lower()) if name == "prefix" else F.levenshtein("word", F.lit(asked.lower()), distance) >= 0
        elif len(found := index.lexicon().join(like, "word", "left_semi").select("word", "term").limit(FEW + 1).collect()) <= FEW:
            test = term.isin(sorted({r.term for r in found})) & word.isin(sorted({r.word for r in found}))
        else:
            posted = posted.join(like.select("word", F.lit(True).alias(name)), "word", "left")
            test = F.coalesce(F.col(name), F.lit(False))
        tests.append(test)
        needs.append(F.max(test))
    ids = None
    if all_of or any_of or prefix or fuzzy:
        some = reduce(lambda a, b: a | b, tests)
        met = posted.where(some).groupBy("id").agg(*[n.alias(f"n{i}") for i, n in enumerate(needs)])
        ids = met.where(reduce(lambda a, b: a & b, [F.col(f"n{i}") for i in range(len(needs))])).select("id")
    elif none_of:
        ids = index.ids().join(posted.where(term.isin(none_of)), "id", "left_anti")
    if phrase and (words := index.terms_of([phrase])[0]):
        order = list(enumerate(words))
        if index.saved is not None:  # the rarest word's places come first, and the others' meet them
            n = {r.term: r.n for r in index.lexicon().where(term.isin(sorted(set(words)))).groupBy("term").agg(F.sum("n").alias("n")).collect()}
            order.sort(key=lambda x: n.get(x[1], 0))
        at = [index.terms.where(term == w).select("id", "field", (F.col("pos") - i).alias("start")) for i, w in order]
        found = reduce(lambda a, b: a.join(b, ["id", "field", "start"], "left_semi"), at).select("id").distinct()
        ids = found if ids is None else ids.join(found, "id", "left_semi")
    return index.ids() if ids is None else ids
