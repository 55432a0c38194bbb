"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, divergence, exact_dedup, language, licenses, mixing, ngram_join, pii, quality, secrets, sharding, suffix_dedup, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(_table(spark, sf_dir, "documents")))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.describe_rows(_table(spark, sf_dir, "documents"))
    cut = sharding.hilbert_shards(rows, 24, group="text_key")
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_kept = F.octet_length("kept")
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - n_kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_divergence": op13_source_divergence,
    "op7_secret_scan": op7_secret_scan,
    "op6_personal_data": op6_personal_data,
    "op4_license_scan": op4_license_scan,
    "op9_quality_resampling": op9_quality_resampling,
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op5_hilbert_sharding": op5_hilbert_sharding,
    "op8_exact_dedup": op8_exact_dedup,
    "op10_source_mixing": op10_source_mixing,
}

#: The licence templates as SQL rows.
_TEMPLATES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(licenses.TEMPLATES))
#: Sizes of windows, each with the next smaller one.
_SHAPES = ", ".join(f"({w}, {before})" for before, w in zip((0, *licenses.WINDOWS), licenses.WINDOWS))
#: One round of the codebooks: the nearest entry of each distinct part, and the entries moved to the mean of theirs.
_NEAREST = """(
            SELECT p, piece, n, e, dist FROM (
                SELECT u.p, u.piece, u.n, b.e, list_sum(list_transform(list_zip(u.piece, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist,
                       row_number() OVER (PARTITION BY u.p, u.piece ORDER BY list_sum(list_transform(list_zip(u.piece, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e) AS r
                FROM uniq u JOIN {book} b ON b.p = u.p) WHERE r = 1)"""
_MOVED = """(
            SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN (
                SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS c FROM (
                    SELECT p, e, k, sum(piece[k] * n) AS s, sum(n) AS n FROM {near}, (SELECT unnest(range(1, d + 1)) AS k FROM width) GROUP BY ALL) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""
_FILE = r"'(?i)^(licen[cs]e|copying|notice)([._-].*)?$'"

ORACLES = {
    "op11_suffix_dedup": r"""
        WITH docs AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        chunks AS (SELECT doc_id, g * 1000 AS base, least(1000, n - 99 - g * 1000) AS many, substr(h, 1 + g * 2000, 2198) AS part FROM docs, unnest(range(0, greatest((n + 900) // 1000, 0))) u(g) WHERE n >= 100),
        starts AS (SELECT doc_id, base + i AS pos, substr(part, 2 * i + 1, 200) AS string FROM (SELECT doc_id, base, part, unnest(range(greatest(many, 0))) AS i FROM chunks)),
        windows AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY string ORDER BY doc_id, pos) AS r FROM starts),
        later AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 100 THEN 0 ELSE 1 END AS opens FROM windows WHERE r > 1),
        spans AS (SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM later) GROUP BY doc_id, g),
        gaps AS (
            SELECT doc_id, coalesce(lag(b) OVER w, 0) AS x, a AS y FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
            UNION ALL SELECT doc_id, max(b), max(n) FROM spans JOIN docs USING (doc_id) GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
        counts AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
        FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_vector_codes": f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        width AS (SELECT max(len(v)) // 16 AS d FROM kept),
        parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * d + 1:(p + 1) * d] AS piece FROM kept, width, (SELECT unnest(range(16)) AS p)),
        uniq AS MATERIALIZED (SELECT p, piece, count(*) AS n FROM parts GROUP BY ALL),
        book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, piece AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
        near0 AS MATERIALIZED {_NEAREST.format(book="book0")},
        book1 AS MATERIALIZED {_MOVED.format(book="book0", near="near0")},
        near1 AS MATERIALIZED {_NEAREST.format(book="book1")},
        book2 AS MATERIALIZED {_MOVED.format(book="book1", near="near1")},
        near2 AS MATERIALIZED {_NEAREST.format(book="book2")},
        signed AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM book2),
        coded AS (
            SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error
            FROM parts JOIN near2 USING (p, piece) GROUP BY vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM coded, signed""",
    "op13_source_divergence": r"""
        WITH rows AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        words AS (SELECT row, lang, source, unnest(w) AS term FROM rows),
        kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 3),
        counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
        sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
        groups AS MATERIALIZED (
            SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM rows) g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
        dense AS MATERIALIZED (
            SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v)) AS p, (1 + 1000000000::HUGEINT * (lang_n + 1) // (lang_total + v)) AS q
            FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        every AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM dense WHERE n > 0 AND p > q)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM every) WHERE part = 'pair' OR rank <= 200""",
    "op3_jaccard_join": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
        runs AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' '))) ELSE [hash(array_to_string(w, ' '))] END) AS s
            FROM words WHERE len(w) > 0),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n, sum(s::HUGEINT) AS one, bit_xor(s) AS two FROM runs GROUP BY doc_id),
        links AS MATERIALIZED (
            SELECT a.doc_id AS u, b.doc_id AS v FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9),
        reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
        least AS (SELECT u, min(v) AS low FROM reach GROUP BY u),
        counts AS (SELECT u, count(*) AS n_links FROM links GROUP BY u),
        reps AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n, one, two) AS rep_id, n FROM sizes)
        SELECT d.doc_id, least(d.doc_id, coalesce(low, d.doc_id)) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(rep_id, d.doc_id) AS rep_id, coalesce(n, 0)::INTEGER AS n_shingles
        FROM documents d LEFT JOIN reps USING (doc_id) LEFT JOIN least ON least.u = d.doc_id LEFT JOIN counts ON counts.u = d.doc_id""",
    "op4_license_scan": rf"""
        WITH templates AS (SELECT * FROM (VALUES {_TEMPLATES}) v(template, license, text)),
        tterms AS (SELECT template, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM templates),
        dterms AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS term FROM documents),
        freq AS (SELECT term, count(*) AS df FROM dterms GROUP BY term),
        total AS (SELECT count(*) AS n FROM documents),
        idf AS (SELECT term, ln((1 + (SELECT n FROM total)) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT term FROM freq UNION SELECT term FROM tterms) LEFT JOIN freq USING (term)),
        tw AS (SELECT template, license, term, any_value(idf) AS idf, count(*) * any_value(idf) AS w FROM tterms JOIN idf USING (term) GROUP BY ALL),
        weights AS (SELECT template, license, term, idf, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS weight FROM tw),
        anchors AS (
            SELECT list(DISTINCT term) AS marks FROM (
                SELECT term, 1 - coalesce(sum(weight * weight) OVER (PARTITION BY template ORDER BY idf DESC, term DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM weights)
            WHERE sqrt(greatest(rest, 0)) >= 0.7 - 1e-9),
        named AS (
            SELECT doc_id, lower(text) AS low, coalesce(source, 'unknown') AS a, coalesce(lang, 'unknown') AS b, CAST(doc_id // 100 AS VARCHAR) AS c,
                   regexp_matches(lower(text), '(^|\n)({licenses.NOTICE})') AND doc_id % 3 = 0 AS opens FROM documents),
        files AS (
            SELECT doc_id, low, CASE WHEN NOT opens THEN a || '/' || b || '/' || c || '/' || doc_id || '.txt' ELSE CASE (doc_id // 3) % 3 WHEN 0 THEN a WHEN 1 THEN a || '/' || b ELSE a || '/' || b || '/' || c END || '/LICENSE.' || doc_id END AS path FROM named),
        lines AS (SELECT doc_id, path, ls, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, path, string_split(low, chr(10)) AS ls FROM files)),
        anchored AS (SELECT lines.* FROM lines, anchors WHERE list_has_any(regexp_extract_all(ls[line], '[\p{{L}}\p{{N}}]+'), marks)),
        shapes AS (SELECT * FROM (VALUES {_SHAPES}) v(w, earlier)),
        every AS (
            SELECT doc_id, path, line, w, array_to_string(ls[line:line + w - 1], chr(10)) AS unit FROM anchored, shapes WHERE earlier = 0 OR line + earlier <= len(ls)
            UNION ALL SELECT doc_id, path, 0, 0, low FROM files WHERE contains(low, chr(10)) AND regexp_matches(string_split(path, '/')[-1], {_FILE})),
        units AS (SELECT * FROM every WHERE NOT regexp_matches(unit, '{licenses.NEGATED}')),
        words AS (SELECT doc_id, path, line, w, term, count(*) AS tf FROM (SELECT doc_id, path, line, w, unnest(regexp_extract_all(unit, '[\p{{L}}\p{{N}}]+')) AS term FROM units) GROUP BY ALL),
        weighed AS (SELECT words.*, tf * idf AS x FROM words JOIN idf USING (term)),
        norms AS (SELECT doc_id, line, w, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY ALL),
        dots AS (SELECT doc_id, path, line, w, template, license, sum(x * weight) AS dot FROM weighed JOIN weights USING (term) GROUP BY ALL),
        scored AS (SELECT dots.*, round(dot / norm, 6) AS score FROM dots JOIN norms USING (doc_id, line, w)),
        own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line, w, template) AS r FROM scored WHERE score >= 0.7) WHERE r = 1),
        dirs AS (SELECT doc_id, path, array_to_string(string_split(path, '/')[1:-2], '/') AS dir, regexp_matches(string_split(path, '/')[-1], {_FILE}) AS is_file FROM files),
        given AS (
            SELECT * FROM (SELECT dir, own.path, license, score, row_number() OVER (PARTITION BY dir ORDER BY score DESC, own.path) AS r FROM own JOIN dirs USING (doc_id) WHERE is_file) WHERE r = 1),
        climb AS (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM dirs)),
        lent AS (
            SELECT climb.dir, arg_max(given.path, depth) AS path, arg_max(license, depth) AS license, arg_max(score, depth) AS score
            FROM climb JOIN given ON given.dir = array_to_string(string_split(climb.dir, '/')[1:depth], '/') GROUP BY climb.dir)
        SELECT d.doc_id, d.path, coalesce(own.license, lent.license) AS license, coalesce(own.score, lent.score) AS score, own.line::INTEGER AS line,
               CASE WHEN own.doc_id IS NOT NULL AND is_file THEN 'file' WHEN own.doc_id IS NOT NULL THEN 'header' WHEN lent.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
               CASE WHEN own.doc_id IS NULL THEN lent.path END AS license_file
        FROM dirs d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN lent ON lent.dir = d.dir""",
    "op1_decontamination": r"""
        WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
        item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
        doc_runs AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
            FROM doc_words WHERE len(w) > 0),
        item_runs AS (
            SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
            FROM item_words WHERE len(w) > 0),
        sized AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_item FROM item_runs),
        shared AS (SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM doc_runs JOIN sized USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, n_shared / n_item AS containment, n_shared, n_item FROM shared WHERE n_shared / n_item >= 0.8""",
    "op8_exact_dedup": r"""
        WITH bare AS (
            SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        led AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(body) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size FROM bare)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM led""",
    "op10_source_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
        placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, source_size * 3.0::DOUBLE AS most FROM sized),
        weighed AS (SELECT *, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM placed),
        levels AS (
            SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
        shared AS (
            SELECT *, least(most, weight * (SELECT max(level) FROM levels WHERE level <= most / weight)) AS target FROM levels),
        queued AS (
            SELECT d.*, s.source_size, s.target, CAST(round(s.target) AS BIGINT) AS budget,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM docs d JOIN shared s ON d.source IS NOT DISTINCT FROM s.source)
        SELECT doc_id, size, source_size, target,
               CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) ELSE 0 END AS BIGINT) AS taken
        FROM queued""",
}
