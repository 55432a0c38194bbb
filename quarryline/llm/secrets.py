"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a maximal run of at least ``MIN_LENGTH`` key characters, or a value of at least ``MIN_VALUE`` characters
of any kind but blanks and quotes that is assigned to a name of a secret. Features: its length and classes of
characters, the transitions between them and their mean log probability under the corpus' letter pairs, the share
of it that words of the corpus cover, the path, and the words and marks beside it. The pair model and the
vocabulary are statistics of all documents, and every word of the vocabulary counts: the substrings of each
distinct run of letters are joined to it. The forest is trained on a table of labelled findings.

Everything is built from DataFrame functions and Spark's own forest, which runs in the JVM.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.runtime import written

MIN_LENGTH = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}"
#: Characters beside a candidate that count as its neighbourhood.
BESIDE = 40
#: Words that name a secret, marks of a value, places of samples.
NAMES = r"(?i)(secret|token|passw|pwd|api.?key|access.?key|auth|credential|private)"
ASSIGNED = r"[=:]\s*[\"'`]?$"
#: A secret's name and the mark that assigns a value to it; lengths are bounded, so that it can stand behind a value.
GIVEN = r"(?:secret|token|passw|pwd|api.?key|access.?key|auth|credential|private)[A-Za-z0-9_.-]{0,40}[\"'`]?\s{0,4}[=:]\s{0,4}"
MIN_VALUE = 6
#: A quoted value is whole; one without quotes does not end in punctuation.
VALUE = rf"(?<=(?i:{GIVEN})[\"'`])[^\s\"'`]{{{MIN_VALUE},}}|(?<=(?i:{GIVEN}))[^\s\"'`]{{{MIN_VALUE - 1},}}[^\s\"'`.,;:)\]}}>]"
SAMPLES = r"(?i)(test|example|sample|fixture|mock|doc)"
#: Letters of a word that can cover a part of a candidate.
WORD_LENGTHS = (4, 15)
#: A vocabulary of at most so many words is broadcast; larger ones are joined by shuffle.
BROADCAST_WORDS = 200_000
#: Positions of a run of letters that become substrings from one row.
_PIECE = 1000
#: Letters are classes of their own; 26 stands for digits, 27 for the rest.
_CLASSES = 28
FEATURES = ("length", "digits", "upper", "lower", "marks", "others", "changes", "variety", "pair_score", "covered", "named", "assigned", "quoted", "sample_path", "path_depth", "before_words")


def _class(c: Column) -> Column:
    low = F.ascii(F.lower(c))
    return F.when(low.between(97, 122), low - 97).when(low.between(48, 57), F.lit(26)).otherwise(F.lit(27))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents: lower-case runs of 2 to 15 Latin letters outside candidates.

    Letters within keys are no words: a key in many documents would cover itself.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), rf"(?<![A-Za-z0-9+/_=-]){CANDIDATE}", " ")
    words = docs.select(F.explode_outer(F.split(F.lower(text), "[^a-z]+")).alias("word"))
    return words.where(F.length("word").between(2, 15)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_table(words: DataFrame) -> list[float]:
    """Log probability of the second class after the first, smoothed by one; 28 x 28 numbers."""
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("pair"))
    seen = {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # 26 x 26 rows at most
    table = [[1.0] * _CLASSES for _ in range(_CLASSES)]
    for pair, n in seen.items():
        table[ord(pair[0]) - 97][ord(pair[1]) - 97] += n
    return [math.log(x / sum(row)) for row in table for x in row]


def covering_words(words: DataFrame, least: int = 5) -> DataFrame:
    """(word): all words of four letters and more that occur ``least`` times."""
    return words.where((F.length("word") >= WORD_LENGTHS[0]) & (F.col("n") >= least)).select("word")


def _digest(name: str) -> Column:
    """16 bytes in place of a text of any length."""
    return F.substring(F.unhex(F.sha2(name, 256)), 1, 16)


def covered_letters(found: DataFrame, words: DataFrame) -> DataFrame:
    """(key, letters) per distinct ``key``, candidate of ``found``: letters within words, the first and longest first.

    Words are letters only, so each distinct run of letters is read once, whatever candidates it stands in.
    """
    low, high = WORD_LENGTHS
    runs = found.select("key", "candidate").dropDuplicates(["key"]).select("key", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(rf"[a-z]{{{low},}}"), F.lit(0))).alias("run"))
    runs = runs.groupBy("key", _digest("run").alias("run_key")).agg(F.first("run").alias("run"), F.count(F.lit(1)).alias("times"))
    # Long runs are cut into overlapping pieces first, so that no row carries a long run for each of its positions.
    piece = lambda at: F.struct(at.alias("at"), F.substr("run", at, F.lit(_PIECE + high - 1)).alias("piece"))
    parts = runs.select("run_key", "run").dropDuplicates(["run_key"]).select("run_key", F.explode(F.transform(F.sequence(F.lit(1), F.length("run"), F.lit(_PIECE)), piece)).alias("p")).select("run_key", "p.*")
    last = F.least(F.length("piece") - low + 1, F.lit(_PIECE))
    parts = parts.where(F.length("piece") >= low).select("run_key", "at", "piece", F.explode(F.sequence(F.lit(1), last)).alias("i"))
    lengths = F.sequence(F.lit(low), F.least(F.lit(high), F.length("piece") - F.col("i") + 1))
    parts = parts.select("run_key", (F.col("at") + F.col("i")).alias("start"), F.explode(F.transform(lengths, lambda n: F.substr("piece", F.col("i"), n))).alias("word"))
    hits = parts.join(words, "word").groupBy("run_key").agg(F.sort_array(F.collect_list(F.struct("start", (-F.length("word")).alias("less")))).alias("hits"))
    step = lambda end, letters: F.struct(end.cast("int").alias("end"), letters.cast("int").alias("letters"))
    read = F.aggregate("hits", step(F.lit(0), F.lit(0)), lambda a, h: F.when(h["start"] >= a["end"], step(h["start"] - h["less"], a["letters"] - h["less"])).otherwise(a))
    hits = hits.select("run_key", read["letters"].alias("letters"))
    return runs.select("key", "run_key", "times").join(hits, "run_key").groupBy("key").agg(F.sum(F.col("times") * F.col("letters")).alias("letters"))


def candidates(files: DataFrame) -> DataFrame:
    """(doc_id, path, text_key, start, candidate, before, after): every run of key characters, from 0 in code points."""
    return matches(files, CANDIDATE)


def assigned_values(files: DataFrame) -> DataFrame:
    """Like ``candidates``, every value that is assigned to a name of a secret."""
    # Most texts have none of the names' beginnings; only the others are worth the expression.
    low = F.lower(F.coalesce("text", F.lit("")))
    some = F.lit(False)
    for name in ("secret", "token", "passw", "pwd", "api", "access", "auth", "credential", "private"):
        some = some | F.contains(low, F.lit(name))
    return matches(files.where(some & low.rlike(GIVEN)), VALUE)


def all_candidates(files: DataFrame) -> DataFrame:
    """Both kinds of candidates; a span that is of both kinds is one row, with the neighbourhood of the run."""
    both = candidates(files).withColumn("kind", F.lit(0)).unionByName(assigned_values(files).withColumn("kind", F.lit(1)))
    both = both.groupBy("doc_id", "path", "text_key", "start", "candidate").agg(F.min(F.struct("kind", "before", "after")).alias("beside"))
    return both.select("doc_id", "path", "start", "candidate", "beside.before", "beside.after")


def matches(files: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, path, text_key, start, candidate, before, after): every match in every whole text.

    ``split`` and ``regexp_extract_all`` give what lies between and the candidates; running sums of their lengths
    give the positions. Rows with one doc_id, path and text are one file.
    """
    text = F.coalesce("text", F.lit(""))
    # Few texts can hold a candidate at all when they have no long run; the others end here.
    rows = files.where(text.rlike(pattern)).select("doc_id", "path", F.xxhash64(text).alias("key"), F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    cut = lambda g: F.struct(F.length(g).alias("length"), F.right(g, F.lit(BESIDE)).alias("tail"), F.left(g, F.lit(BESIDE)).alias("head"))
    rows = rows.select("doc_id", "path", "key", F.posexplode_outer(F.arrays_zip(F.transform("gaps", cut).alias("gap"), F.col("found").alias("found"), F.slice(F.transform("gaps", cut), F.lit(2), F.size("gaps")).alias("next"))).alias("i", "x"))
    rows = rows.select("doc_id", "path", "key", "i", F.col("x.gap.length").alias("gap"), F.col("x.gap.tail").alias("before"), F.col("x.found").alias("candidate"), F.col("x.next.head").alias("after")).where(F.col("candidate").isNotNull())
    rows = rows.dropDuplicates(["doc_id", "path", "key", "i"])
    run = Window.partitionBy("doc_id", "path", "key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.col("gap") + F.length("candidate")).over(run), F.lit(0))
    return rows.select("doc_id", "path", F.col("key").alias("text_key"), (ahead + F.col("gap")).cast("long").alias("start"), "candidate", "before", "after")


def _table(spark: SparkSession, words: DataFrame | list[str]) -> DataFrame:
    return words if isinstance(words, DataFrame) else spark.createDataFrame([(w,) for w in words], "word string")


def features(found: DataFrame, pairs: list[float], words: DataFrame | list[str]) -> DataFrame:
    """``found`` (candidate, before, after, path) with one column per feature; ``words`` is a table (word) or a list."""
    found = found.withColumn("key", _digest("candidate"))
    found = found.join(covered_letters(found, _table(found.sparkSession, words)), "key", "left")
    c = F.col("candidate")
    n = F.length(c).cast("double")
    table = F.array(*[F.lit(float(x)) for x in pairs])
    letters = F.split(c, "")

    def score(classes: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(classes) - 1), F.lit(0.0), lambda total, i: total + F.get(table, F.get(classes, i - 1) * _CLASSES + F.get(classes, i)))

    bound = F.transform(F.array(F.transform(letters, _class)), score)[0]
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    path = F.coalesce("path", F.lit(""))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return found.withColumns(
        {
            "length": F.least(n, F.lit(200.0)),
            "digits": share("[0-9]"),
            "upper": share("[A-Z]"),
            "lower": share("[a-z]"),
            "marks": share("[+/_=-]"),
            "others": share(r"[^A-Za-z0-9+/_=-]"),
            "changes": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
            "variety": F.size(F.array_distinct(letters)) / F.least(n, F.lit(64.0)),
            "pair_score": bound / F.greatest(n - 1, F.lit(1.0)),
            "covered": F.coalesce("letters", F.lit(0)) / n,
            "named": flag(F.col("before").rlike(NAMES)),
            "assigned": flag(F.col("before").rlike(ASSIGNED)),
            "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
            "sample_path": flag(path.rlike(SAMPLES)),
            "path_depth": F.regexp_count(path, F.lit("/")).cast("double"),
            "before_words": F.regexp_count(F.coalesce("before", F.lit("")), F.lit("[A-Za-z]{2,}")).cast("double"),
        }
    ).drop("key", "letters")


def labelled_findings(spark: SparkSession, words: DataFrame | list[str], n: int = 4000) -> DataFrame:
    """(candidate, before, after, path, label): findings made by rule from hashes and the corpus' words.

    The words are drawn from the whole of ``words``, a table (word) or a list, at least one for every place of a word.

    Secrets are random strings in the alphabets of keys, with or without a name before them; the others are
    words run together, in capitals or joined by marks, card and serial numbers, fillers and digests named as such.
    Short or dotted values assigned to a secret's name are secrets when they are random, none when they are words.
    """
    ids = spark.range(n).withColumns({"hex": F.sha2(F.col("id").cast("string"), 256), "kind": F.pmod(F.xxhash64("id"), F.lit(15)), "form": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4))})
    drawn = _table(spark, words).orderBy(F.xxhash64("word"), "word").limit(16 * n).agg(F.sort_array(F.collect_list("word")).alias("drawn"))
    ids = ids.crossJoin(F.broadcast(drawn))  # one row
    dictionary = F.when(F.size("drawn") > 0, F.col("drawn")).otherwise(F.array(F.lit("word"), F.lit("text"), F.lit("line")))
    pick = lambda k: F.element_at(dictionary, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(dictionary)) + 1).cast("int"))
    b64 = F.translate(F.base64(F.unhex("hex")), "\n", "")
    joined = lambda mark: F.concat_ws(mark, *[pick(k) for k in range(10, 15)])
    numbers = F.translate("hex", "abcdef", "012345")
    candidate = (
        F.when(F.col("kind") == 0, F.substring("hex", 1, 40))
        .when(F.col("kind") == 1, F.substring("hex", 1, 32))
        .when(F.col("kind") == 2, F.concat(F.lit("AKIA"), F.substring(F.translate(F.upper(F.regexp_replace(b64, "[+/=]", "")), "0189", "ABCD"), 1, 16)))
        .when(F.col("kind") == 3, F.substring(b64, 1, 40))
        .when(F.col("kind") == 4, F.concat(F.lit("sk-"), F.substring(F.regexp_replace(b64, "[+/=]", ""), 1, 28)))
        .when(F.col("kind") == 5, F.when(F.col("form") < 2, F.initcap(joined(""))).otherwise(joined("")))
        .when(F.col("kind") == 6, F.upper(joined("")))
        .when(F.col("kind") == 7, joined("-"))
        .when(F.col("kind") == 8, F.concat(joined("/"), F.lit("/"), pick(20)))
        .when(F.col("kind") == 9, F.substring(numbers, 1, 16))
        .when(F.col("kind") == 10, F.concat(pick(21), F.repeat(F.substring("hex", 1, 1), 20)))
        .when(F.col("kind") == 11, joined("_"))
        .when(F.col("kind") == 12, F.concat(F.initcap(F.substring(pick(22), 1, 4)), F.substring(numbers, 1, 2), F.element_at(F.array(*[F.lit(x) for x in "!@$%&#.?"]), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(8)).cast("int") + 1), F.substring(b64, 1, F.col("form").cast("int") + 3)))
        .when(F.col("kind") == 13, F.concat_ws(".", F.substring(b64, 1, 20), F.substring(b64, 5, 30), F.substring(b64, 9, 27)))
        .otherwise(F.when(F.col("form") < 3, F.concat(pick(23), F.lit("ly"))).otherwise(F.concat(pick(23), F.lit("."), pick(24))))
    )
    value = F.col("kind") >= 12
    secret = (F.col("kind") <= 4) | F.col("kind").isin(12, 13)
    names = F.element_at(F.array(*[F.lit(x) for x in ("token = \"", "secret: \"", "api_key='", "password=\"")]), F.col("form").cast("int") + 1)
    named = value | (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) > 0)
    before = F.concat(pick(30), F.lit(" "), pick(31), F.lit(" "), F.when((secret | value) & named, names).when(~secret & (F.col("form") == 0), F.lit("name = \"")).otherwise(F.lit("")))
    after = F.concat(F.when(before.rlike("[\"']$"), F.substring(before, -1, 1)).otherwise(F.lit(" ")), pick(32))
    path = F.concat_ws("/", F.lit("src"), pick(33), F.when(~secret & (F.col("form") == 1), F.lit("tests")), F.concat(pick(34), F.lit(".txt")))
    return ids.select(candidate.alias("candidate"), before.alias("before"), after.alias("after"), path.alias("path"), secret.cast("double").alias("label")).where(F.length("candidate") >= F.when(value, MIN_VALUE).otherwise(MIN_LENGTH))


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(rows)


def train_forest(rows: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel:
    """``rows`` have the features and a label."""
    return RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(assembled(rows))


def scan(files: DataFrame, findings: DataFrame | None = None, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, path, start, length, preview, digest, score, is_secret.

    ``files`` has doc_id, path and text; ``findings`` replaces the built-in labelled table (candidate, before,
    after, path, label). ``start`` counts code points from 0; ``preview`` shows the first four characters and
    ``digest`` is the SHA-256 of the candidate. Words that occur ``least`` times cover candidates. Whole texts are read; null and empty ones have no candidate. A
    null path has no features of its own. Repeated rows count once. Empty tables give no rows; other columns
    are ignored.
    """
    words = written(vocabulary(files), "vocabulary")
    pairs, known = pair_table(words), covering_words(words, least)
    labelled = findings if findings is not None else labelled_findings(files.sparkSession, known)
    if known.count() <= BROADCAST_WORDS:
        known = F.broadcast(known)
    # Fixed places of the rows keep the forest's draws the same in every run.
    rows = features(labelled, pairs, known).repartition(16, "candidate", "before", "after", "path").sortWithinPartitions("candidate", "before", "after", "path", "label")
    # The labelled table only; read several times by the forest.
    rows = rows.cache()
    forest = train_forest(rows)
    rows.unpersist()
    scored = forest.transform(assembled(features(written(all_candidates(files), "candidates"), pairs, known)))
    chance = F.round(vector_to_array("probability")[1], 6)
    return scored.select(
        "doc_id",
        "path",
        "start",
        F.length("candidate").cast("long").alias("length"),
        F.concat(F.left("candidate", F.lit(4)), F.lit("...")).alias("preview"),
        F.sha2("candidate", 256).alias("digest"),
        chance.alias("score"),
        (chance >= threshold).alias("is_secret"),
    )
