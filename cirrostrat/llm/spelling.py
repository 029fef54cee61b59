"""Groups of spelling variants: words one edit apart, joined by even partitions.

A word of L code points has two segments, its first L // 2 code points and the
others. One edit leaves one of them as it is, so a word is indexed under both
(with L and which one it is). Two words of a length that are one replacement
apart share a segment in its place. A word one longer has a segment of the
shorter one as its own beginning, or moved by one place: it probes with these
two substrings. Candidates that share a key are compared (the built-in edit
distance, bounded by 1); a pair that is found under two keys counts once.

A key that more than CROWD entries share is not compared as a whole. What
follows from its words being alike in that segment is the same task on what
they have besides it, so that part is cut in two again, and so on: a key gets
longer until few words share it. Where one code point is left, no more words
can share a key than there are letters (and pairs of letters for the longer
words). No pair is lost, as every cut keeps the rule above.

All of it is DataFrame operations. Counting words adds up within tasks before
the shuffle, so a very frequent word is no hot key; the tables of keys grow with
the number of different words, not with the text.

Defined cases: a null text has no words; a null identifier is written as an
empty string where the text is hashed; repeated rows count as often as they are
there; a run of any length is a word as it is; words with the same number of
occurrences are told apart by code-point order; an empty table gives no words.
Only identifier and text are read, so other columns of any name don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form has at least so many times the word's occurrences.
RATIO = 5
#: One occurrence of a run in so many texts loses a code point (the query's own noise; 0: none).
NOISE = 199
#: Entries that share a key and are compared with each other.
CROWD = 128
#: Crowded keys (8 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST = 1 << 20


def _lower(run: Column) -> Column:
    """A-Z lower-cased only. lower() does that where there are no other letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, upper, upper.lower()))


def words_of(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: different words and how often they occur. Runs shorter than a word never become one, so they are
    passed over while the text is read."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    run = F.col("run")
    runs = runs.select("d", _lower(run).alias("run"))
    if noise:
        h = F.crc32(F.concat("d", F.lit(":"), run).cast("binary"))
        at = (h % F.char_length(run)).cast("int")
        short = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
        runs = runs.select(F.when(h % noise == 0, short).otherwise(run).alias("run"))
    return runs.where(F.char_length(run) >= least_length).groupBy(run.alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _cut(items: DataFrame) -> DataFrame:
    """Both segments of each item's text as keys. items: key, longer, word, n, rest; an item that is longer is
    matched with texts one code point shorter."""
    size = F.char_length("rest") - F.col("longer").cast("int")  # of the indexed text
    half = F.floor(size / 2).cast("int")
    moved = F.col("longer").cast("int")
    first = F.struct(F.lit(1).alias("i"), F.substring(F.col("rest"), F.lit(1), half).alias("segment"), F.substring(F.col("rest"), half + 1, F.char_length("rest")).alias("rest"))
    second = F.struct(F.lit(2).alias("i"), F.substring(F.col("rest"), half + moved + 1, size - half).alias("segment"), F.substring(F.col("rest"), F.lit(1), half + moved).alias("rest"))
    each = items.select("key", "longer", "word", "n", F.explode(F.array(first, second)).alias("s"))
    return each.select(F.xxhash64("key", "s.i", "s.segment").alias("key"), "longer", "word", "n", F.col("s.rest").alias("rest"))


def _with_keys(items: DataFrame, keys: DataFrame, count: int, how: str) -> DataFrame:
    return items.join(F.broadcast(keys) if count <= BROADCAST else keys, "key", how)


def near_pairs(words: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """a, na, b, nb: every pair of words one edit apart, once. words: word (different ones), n; read several times."""
    L = F.char_length("word").cast("long")
    items = words.select(F.explode(F.array(F.struct(L.alias("key"), F.lit(False).alias("longer")), F.struct((L - 1).alias("key"), F.lit(True).alias("longer")))).alias("s"), "word", "n", F.col("word").alias("rest")).select("s.*", "word", "n", "rest")
    found, tables = [], []
    while True:
        keyed = _cut(items)
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("rest") - F.col("longer").cast("int")).alias("left"))
        crowded = common.stored(sizes.where((F.col("n") > crowd) & (F.col("left") > 1)).select("key"), "spelling-crowded")
        n = crowded.count()
        tables.append(crowded)
        few = _with_keys(keyed, crowded, n, "left_anti") if n else keyed
        a = few.where(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("na"))
        b = few.select("key", F.col("longer"), F.col("word").alias("b"), F.col("n").alias("nb"))
        both = a.join(b, "key").where(F.col("longer") | (F.col("a") < F.col("b")))
        found.append(both.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb"))
        if not n:
            break
        items = common.stored(_with_keys(keyed, crowded, n, "left_semi"), "spelling-items")
        tables.append(items)
    pairs = common.stored(reduce(DataFrame.unionByName, found).distinct(), "spelling-pairs")
    common.release(*tables)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms from each word on. forms: word, form; occurrences grow along them, so
    they have no circles. Each round follows twice as many of them."""
    at = common.stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = at.join(step, "root", "left")
        after = common.stored(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        common.release(at)
        at = after
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")


def variants(words: DataFrame, *, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """For each word: form (its near word of most occurrences, if these are ratio times its own), root, n, n_near,
    form_n. words: word, n."""
    words = common.stored(words, "spelling-words")
    pairs = near_pairs(words, crowd=crowd)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    good = -F.col("best.m") >= F.col("n") * ratio
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n"))
    rows = common.stored(rows, "spelling-forms")
    out = rows.join(roots(rows.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(words_of(common.read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def _sql() -> str:
    """CRC-32 as SQL: four bits at a time, with the table of 16 values that its polynomial gives."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    values = f"[{', '.join(f'{x}::BIGINT' for x in table)}]"
    nibble = lambda c: f"xor({c} >> 4, {values}[({c} & 15) + 1])"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(d || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: {nibble(nibble('xor(c, b)'))}), 4294967295)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), '{upper}', '{upper.lower()}') AS run FROM documents),
each AS (SELECT d, run, count(*) AS c FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, c, {crc} AS h FROM each),
words AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_LENGTH} AND sum(c) >= {LEAST_COUNT}),
places AS (SELECT word, CAST(unnest(range(length(word))) AS BIGINT) AS i FROM words),
masked AS (SELECT word, left(word, i) || '*' || substr(word, i + 2) AS mask FROM places),
deleted AS (SELECT DISTINCT word, left(word, i) || substr(word, i + 2) AS short FROM places),
one_less AS (SELECT d.word AS a, w.word AS b FROM deleted d JOIN words w ON w.word = d.short),
near AS (SELECT x.word AS a, y.word AS b FROM masked x JOIN masked y USING (mask) WHERE x.word <> y.word UNION SELECT a, b FROM one_less UNION SELECT b, a FROM one_less),
ranked AS (SELECT a, b, w.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS place FROM near JOIN words w ON w.word = b),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= {RATIO} * w.n THEN b END AS form, CASE WHEN r.n >= {RATIO} * w.n THEN r.n END AS form_n FROM words w LEFT JOIN ranked r ON a = w.word AND place = 1),
path AS (SELECT word, word AS here, 0 AS step FROM forms UNION ALL SELECT path.word, f.form, step + 1 FROM path JOIN forms f ON f.word = path.here WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(here, step) AS root FROM path GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)"""


ORACLE_SQL = _sql()
