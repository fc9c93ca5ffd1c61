r"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers compared by log-likelihood ratio.

Both models are first-order chains over an alphabet of 68 characters, counted from labelled samples; each mixes a part BACKOFF of the frequencies of
single characters into those of pairs, so that a pair not seen in training is no proof by itself. A candidate, a run of CANDIDATE characters with a
letter in it, is a secret if random strings explain it better by at least LIMIT thousandths of a nat, and by at least PER_CHAR of them a character.
A character that is repeated, or next in the alphabet, never speaks for a random string: fillers and alphabets are none. The ratio of the two models
is one table of whole numbers, of a size that the alphabet fixes, and goes into the plan as a constant; scores are sums over it.

Samples for the corpus query: random strings are the values that the patterns find in all documents and, since those are nearly all hexadecimal,
digests of a bounded part of the documents (SAMPLE_DOCS, chosen by hash) in five alphabets: hexadecimal, base 64, its form for URLs, letters with
digits, capitals with digits. Ordinary ones are that part's words, without the values that the patterns find, and identifiers made of three words in
a row as programs write them: snake_case, CamelCase, lowerCamel, kebab-case, paths, capitals, with numbers.

DataFrame functions throughout. Defined cases: a null text is an empty one, without spans; positions count code points, end exclusive; spans of
the models that touch a pattern's span are left out; repeated rows are scanned alike; extra columns stay as they are, but for text, base and spans,
which scan() replaces; with nothing to learn from no candidate is a secret; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.llm.common import stored, table, unused

#: Fixed values of the patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}"
KINDS, MIN_ASSIGN, MIN_ACCESS = ("assign", "access", "hex", "markov"), 6, 20
#: The models' candidates, and by how many thousandths of a nat a random string must be likelier, in sum and a character. Chosen on strings that the
#: models are not trained on: 20 random characters of any of the five alphabets are found in 94 of 100 cases or more, and 0.7 % of the names in Python's libraries are taken for secrets.
CANDIDATE, LIMIT, PER_CHAR = r"[A-Za-z0-9+/_=-]{16,}", 10_000, 900
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
SAMPLE_DOCS, SMOOTH, BACKOFF = 4000, 0.5, 0.1
MASK = "[SECRET]"
_N = len(ALPHABET) + 1  # 0: before the first character, or a character outside the alphabet
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(text: str, pattern: str, kind: int, ok: str) -> str:
    """SQL: spans of the leftmost matches that do not overlap; ok: a condition on m, the matched string, and v, its value."""
    value = 2 if kind == 0 else 0
    parts = f"arrays_zip(slice(split({text}, {_sql(pattern)}, -1), 1, size(regexp_extract_all({text}, {_sql(pattern)}, 0))), regexp_extract_all({text}, {_sql(pattern)}, 0), regexp_extract_all({text}, {_sql(pattern)}, {value}))"
    step = "transform({}, x -> struct(length(x['0']) as gap, length(x['1']) as n, {} as ok))".format(parts, ok.replace("m)", "x['1'])").replace("v)", "x['2'])"))
    return f"""aggregate({step}, struct(0 as at, cast(array() as {_SPANS}) as found), (a, x) -> struct(a.at + x.gap + x.n as at,
        if(x.ok, concat(a.found, array(struct(a.at + x.gap as start, {kind} as kind, a.at + x.gap + x.n as end))), a.found) as found), a -> a.found)"""


def base_spans(text: str) -> Column:
    """What the patterns find in a column: array of (start, kind, end), by start, then kind. The regular expressions run only where a character they need occurs."""
    none = f"cast(array() as {_SPANS})"
    found = [
        f"if((instr({text}, '=') > 0 or instr({text}, ':') > 0) and {text} rlike {_sql(ASSIGN)}, {_places(text, ASSIGN, 0, f'length(v) >= {MIN_ASSIGN}')}, {none})",
        f"if(instr({text}, 'AKIA') > 0, {_places(text, ACCESS, 1, f'length(m) >= {MIN_ACCESS}')}, {none})",
        f"if({text} rlike {_sql(HEX)}, {_places(text, HEX, 2, 'true')}, {none})",
    ]
    return F.expr(f"array_sort(concat({', '.join(found)}))")


def _codes(text: str) -> str:
    return f"transform(split({text}, ''), c -> instr({_sql(ALPHABET)}, c))"


def train(samples: DataFrame) -> list[int]:
    """The table of log-likelihood ratios in thousandths of a nat, at before * 69 + character, from samples (text, random boolean).

    What comes to the driver are the counts of at most 2 * 69 * 69 pairs."""
    codes = samples.where("text <> '' and random is not null").select("random", F.expr(_codes("text")).alias("c"))
    pairs = codes.select("random", F.explode(F.expr("transform(c, (x, i) -> if(i = 0, 0, c[i - 1]) * {0} + x)".format(_N))).alias("pair"))
    n = {k: [[0] * _N for _ in range(_N)] for k in (True, False)}
    got = pairs.groupBy("random", "pair").count().collect()
    if {r.random for r in got} != {True, False}:
        return []
    for r in got:
        n[r.random][r.pair // _N][r.pair % _N] = r["count"]
    p = {k: _chances(v) for k, v in n.items()}

    def one(a: int, b: int) -> int:
        x = round(1000 * math.log(p[True][a][b] / p[False][a][b]))
        return min(x, 0) if a and b and abs(a - b) <= 1 else x

    return [one(a, b) for a in range(_N) for b in range(_N)]


def _chances(n: list[list[int]]) -> list[list[float]]:
    """The chain of counted pairs: of each character the chance after each other."""
    total = sum(map(sum, n))
    alone = [(sum(row[b] for row in n) + SMOOTH) / (total + SMOOTH * _N) for b in range(_N)]
    return [[(1 - BACKOFF) * (row[b] + SMOOTH * alone[b]) / (sum(row) + SMOOTH) + BACKOFF * alone[b] for b in range(_N)] for row in n]


def ratio(text: str, model: list[int]) -> str:
    """SQL: the summed log-likelihood ratio of a string, in thousandths of a nat."""
    known = f"cast(split('{','.join(map(str, model))}', ',') as array<int>)"
    return f"aggregate({_codes(text)}, struct(0 as before, 0 as sum), (a, x) -> struct(x as before, a.sum + {known}[a.before * {_N} + x] as sum), a -> a.sum)"


def samples_of(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, random): labelled samples from docs (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hits = rows.withColumn("spans", base_spans("text")).where("size(spans) > 0")
    value = F.expr(f"explode(transform(spans, s -> regexp_replace(substring(text, s.start + 1, s.end - s.start), {_sql('^' + ASSIGN + '$')}, '$2')))")
    part = min(1.0, sample_docs / max(1, docs.count()))
    few = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < part * 1_000_003)
    digest = F.sha2("text", 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    plain = F.regexp_replace(b64, "[+/]", "")
    random = few.select(F.explode(F.array(digest, b64, F.translate(b64, "+/", "-_"), plain, F.upper(plain))).alias("text"))
    left = few.select(F.expr(f"regexp_replace(regexp_replace(regexp_replace(text, {_sql(ASSIGN)}, ' '), {_sql(ACCESS)}, ' '), {_sql(HEX)}, ' ')").alias("text"))
    words = "filter(split(text, '[^A-Za-z0-9+/_=-]+'), w -> length(w) >= 4)"
    parts = left.select(F.col("text"), F.expr("transform(filter(split(text, '[^A-Za-z]+'), w -> length(w) >= 2), w -> lower(w))").alias("w"))
    threes = "if(size(w) < 3, array(), transform(sequence(0, size(w) - 3, 3), i -> struct(slice(w, i + 1, 3) as g, transform(slice(w, i + 1, 3), x -> initcap(x)) as c, i as i)))"
    named = """flatten(transform({}, t -> array(concat_ws('_', t.g), concat_ws('', t.c), concat(t.g[0], t.c[1], t.c[2]), concat_ws('-', t.g), concat_ws('/', t.g),
        upper(concat_ws('_', t.g)), concat(t.g[0], t.i, '_', t.g[1]))))""".format(threes)
    ordinary = parts.select(F.expr(f"explode(concat({words}, {named}))").alias("text"))
    return hits.select(value.alias("text")).union(random).withColumn("random", F.lit(True)).union(ordinary.withColumn("random", F.lit(False)))


def model_of(docs: DataFrame) -> list[int]:
    """The table trained on a corpus (doc_id, text)."""
    return train(stored(samples_of(docs), "secret-samples"))


def scan(docs: DataFrame, model: list[int], limit: int = LIMIT, per_char: int = PER_CHAR) -> DataFrame:
    """(all columns of docs, base, spans): base is what the patterns find, spans these and the models' finds; arrays of (start, kind, end)."""
    docs = docs.drop("base", "spans").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = docs.withColumn("base", base_spans("text"))
    if not model:
        return out.withColumn("spans", F.col("base"))
    # candidates are scored as strings first; only texts with a secret among them look for its place
    found = unused(docs, "found")
    likely = f"x rlike '[A-Za-z]' and {ratio('x', model)} >= greatest({int(limit)}, {int(per_char)} * length(x))"
    out = out.withColumn(found, F.expr(f"filter(array_distinct(regexp_extract_all(text, {_sql(CANDIDATE)}, 0)), x -> {likely})"))
    places = _places("text", CANDIDATE, 3, f"array_contains({found}, m)")
    more = f"filter(if(size({found}) > 0, {places}, cast(array() as {_SPANS})), m -> not exists(base, b -> b.start < m.end and m.start < b.end))"
    return out.withColumn("spans", F.expr(f"array_sort(concat(base, {more}))")).drop(found)


def masked(text: str, spans: str) -> Column:
    """The text with each stretch of overlapping spans replaced by MASK."""
    return F.expr(f"""aggregate({spans}, struct(0 as at, '' as out), (a, s) -> struct(greatest(a.at, s.end) as at,
        if(s.start >= a.at, concat(a.out, substring({text}, a.at + 1, s.start - a.at), '{MASK}'), a.out) as out), a -> concat(a.out, substring({text}, a.at + 1)))""")


def listed(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scan(docs, model_of(docs))
    n = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return out.select("doc_id", *n, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
