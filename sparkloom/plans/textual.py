"""Queries over the synthetic tables for text and vector operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import fuzzy as Z
from ..operators import identity as I
from ..operators import neardup as D
from ..operators import retrieval as B
from ..operators import semantic as S
from ..session import numbered
from ..session import table as t
from .tabular import R6

CLEAN = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ')"
TOK = lambda x: f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
WDS = lambda x: f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
SHW = lambda x: WDS(f"translate(lower({x}), '.,', '')")


def SHG(table: str, key: str, k: int) -> str:
    return f"sw AS (SELECT {key} AS id, {SHW('text')} AS w FROM {table}), sh AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS s FROM sw WHERE len(w) >= {k})"


POST = lambda table, key: f"tk AS (SELECT {key} AS doc_id, {TOK('text')} AS w FROM {table}), ps AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM tk), tf AS (SELECT term, doc_id, count(*) AS tf FROM ps GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, sum(len(w)) AS n_tokens, avg(len(w)) AS avg_len FROM tk)"
QRY = "qr AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 100 = 0), qt AS (SELECT DISTINCT query_id, unnest(" + TOK("query") + ") AS term FROM qr)"
BM = POST("documents", "doc_id") + ", " + QRY + """, bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.25 / (tf + 1.25 * (0.2 + 0.8 * len(w) / avg_len))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN tk USING (doc_id), st GROUP BY 1, 2),
ti AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm), tir AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ti)"""


def queries_of(s, d):
    return t(s, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def ranked(s, d, model, whole=False):
    return B.search(t(s, d, "documents"), "doc_id", "text", B.query_terms(queries_of(s, d)), model, whole)


def vocabulary(s, d):
    return Z.word_frequency(t(s, d, "part").select(F.explode(T.words(F.col("p_name"))).alias("w")), "w")


def misspelt(s, d):
    """Words of part names without their second letter, of every hundredth part."""
    w = F.explode(T.words(F.lower("p_name")))
    return t(s, d, "part").where("p_partkey % 100 = 0").select(w.alias("w")).where("length(w) > 2").select(F.concat(F.substring("w", 1, 1), F.expr("substring(w, 3)")).alias("query"))


VOC = "voc AS (SELECT lower(w) AS word, count(*) AS freq FROM (SELECT unnest(" + WDS("p_name") + ") AS w FROM part) GROUP BY 1), mq AS (SELECT DISTINCT w[1:1] || w[3:] AS query FROM (SELECT unnest(" + WDS("lower(p_name)") + ") AS w FROM part WHERE p_partkey % 100 = 0) WHERE length(w) > 2)"
DEL = lambda c: f"list_filter(list_distinct(list_concat([{c}], list_transform(range(1, length({c}) + 1), lambda i: {c}[1:i - 1] || {c}[i + 1:]))), lambda x: x <> '')"


DISTINCT = "texts AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text)"
#: Similar pairs of representatives of equal shingle sets, and every other member with its representative.
JACCARD = f"""WITH {SHG('documents', 'doc_id', 5)}, hs AS (SELECT id, list(s ORDER BY s) AS l FROM sh GROUP BY id), rep AS (SELECT min(id) AS id, any_value(len(l)) AS n, l FROM hs GROUP BY l), r AS (SELECT sh.id, s, n FROM sh JOIN rep USING (id)),
i AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM r x JOIN r y USING (s) WHERE x.id < y.id GROUP BY 1, 2, 3, 4)
SELECT a, b, round(c / (na + nb - c)::DOUBLE, 6) AS jaccard FROM i WHERE c / (na + nb - c)::DOUBLE >= 0.8 UNION ALL SELECT rep.id, hs.id, 1.0 FROM hs JOIN rep USING (l) WHERE rep.id <> hs.id"""


def agreements(s, d):
    """Share of equal signature places of every hundredth item with all items."""
    m = D.minhash(t(s, d, "benchmark"), "item_id", "text")
    q, p = (m.select(F.col("item_id").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab")
    return V.in_blocks(q.where("a % 100 = 0"), "a", p).select("a", "b", F.round(D.agreement(F.col("sa"), F.col("sb")), 6).alias("agreement"))
SIG = lambda src: f"ix AS (SELECT range AS i FROM range(100)), mh AS (SELECT id, i, min(sha1(i || '_' || s)) AS m FROM sh, ix GROUP BY 1, 2), sg0 AS (SELECT id, list(m ORDER BY i) AS sig FROM mh GROUP BY id), sg AS (SELECT x.id, coalesce(sig, list_transform(range(100), lambda z: 'inf')) AS sig FROM (SELECT DISTINCT id FROM sw) x LEFT JOIN sg0 USING (id))"

SEN = "sn AS (SELECT item_id, no, regexp_replace(sentence, '^\\s+|\\s+$', '', 'g') AS sentence FROM (SELECT item_id, unnest(string_split(text, '.')) AS sentence, unnest(range(0, len(string_split(text, '.')))) AS no FROM benchmark) WHERE regexp_replace(sentence, '^\\s+|\\s+$', '', 'g') <> '')"


def word_vectors(s, d):
    """A dictionary of the items' first sentences, with vectors from their lengths."""
    first = S.sentences(t(s, d, "benchmark"), "item_id", "text").where("no = 0")
    n = F.length("sentence").cast("double")
    return first.groupBy(F.lower(F.trim("sentence")).alias("text")).agg(F.min(F.struct("item_id", F.col("sentence"))).alias("b")).select("text", F.array(F.length("b.sentence").cast("double"), F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(1.0)).alias("embedding"))


Q: dict[str, tuple] = {
    # identity
    "normalize_text": (lambda s, d: t(s, d, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("clean_md5")), f"SELECT doc_id, md5({CLEAN('text')}) AS clean_md5 FROM documents"),
    "exact_dups": (lambda s, d: I.exact_groups(t(s, d, "documents"), "doc_id", "text"), f"SELECT sha256({CLEAN('text')}) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1"),
    "exact_dups_strict": (lambda s, d: I.exact_groups(t(s, d, "documents"), "doc_id", "text", strict=True), "SELECT sha256(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1"),
    "registry_check": (
        lambda s, d: I.in_registry(t(s, d, "documents").select("doc_id", "text"), t(s, d, "conversations").select("text").unionByName(t(s, d, "benchmark").select("text")), "text").groupBy("known").agg(F.count("*").alias("n")),
        f"WITH r AS (SELECT DISTINCT {CLEAN('text')} AS c FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)) SELECT {CLEAN('text')} IN (SELECT c FROM r) AS known, count(*) AS n FROM documents GROUP BY 1",
    ),
    "bloom_membership": (
        lambda s, d: I.bloom_contains(t(s, d, "nation").select(F.col("n_name").alias("x")).unionByName(t(s, d, "supplier").select(F.col("s_name").alias("x"))), I.bloom_bits(t(s, d, "nation"), "n_name"), "x"),
        "WITH ix AS (SELECT range AS i FROM range(3)), b AS (SELECT list(DISTINCT (('0x' || md5(i || '_' || n_name))::UHUGEINT % 500)::BIGINT) AS bits FROM nation, ix), x AS (SELECT n_name AS x FROM nation UNION ALL SELECT s_name FROM supplier) SELECT x, len(list_filter([0, 1, 2], lambda i: NOT list_contains(bits, (('0x' || md5(i || '_' || x))::UHUGEINT % 500)::BIGINT))) = 0 AS maybe FROM x, b",
    ),
    "bloom_bits": (lambda s, d: I.bloom_bits(t(s, d, "nation"), "n_name"), "SELECT DISTINCT (('0x' || md5(i || '_' || n_name))::UHUGEINT % 500)::BIGINT AS bit FROM nation, range(3) r(i)"),
    "weak_hash_collisions": (
        lambda s, d: I.weak_collisions(t(s, d, "part"), "p_name"),
        "SELECT h, count(*) AS n FROM (SELECT list_sum(list_transform(string_split(p_name, ''), lambda c: unicode(c)))::BIGINT % 256 AS h FROM (SELECT DISTINCT p_name FROM part)) GROUP BY h HAVING count(*) > 1",
    ),
    # fuzzy
    "stem_tokens": (
        lambda s, d: t(s, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy(T.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n")),
        "WITH w AS (SELECT unnest(" + TOK("text") + ") AS w FROM documents) SELECT CASE " + " ".join(f"WHEN ends_with(w, '{x}') AND length(w) > {len(x) + 2} THEN w[1:length(w) - {len(x)}]" for x in T.SUFFIXES) + " ELSE w END AS stem, count(*) AS n FROM w GROUP BY 1",
    ),
    "levenshtein_pairs": (
        lambda s, d: t(s, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("bigint").alias("distance")),
        "SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS distance FROM part",
    ),
    "osa_pairs": (
        lambda s, d: t(s, d, "part").select("p_partkey", Z.osa_distance(F.col("p_name"), F.col("p_type")).cast("bigint").alias("distance")),
        """WITH RECURSIVE o(k, a, b, i, j, before, last, now) AS (SELECT p_partkey, p_name, p_type, 1, 0, [0]::BIGINT[], range(0, length(p_type) + 1), [1]::BIGINT[] FROM part
 UNION ALL SELECT k, a, b, CASE WHEN j = length(b) THEN i + 1 ELSE i END, CASE WHEN j = length(b) THEN 0 ELSE j + 1 END, CASE WHEN j = length(b) THEN last ELSE before END, CASE WHEN j = length(b) THEN now ELSE last END,
 CASE WHEN j = length(b) THEN [i + 1] ELSE list_append(now, least(last[j + 2] + 1, now[j + 1] + 1, last[j + 1] + (a[i] <> b[j + 1])::INTEGER, CASE WHEN i > 1 AND j >= 1 AND a[i] = b[j] AND a[i - 1] = b[j + 1] THEN before[j] + 1 ELSE 1000 END)) END FROM o WHERE i <= length(a))
SELECT k AS p_partkey, last[length(b) + 1]::BIGINT AS distance FROM o WHERE i = length(a) + 1""",
    ),
    "radius_two": (
        lambda s, d: Z.radius_search(misspelt(s, d), vocabulary(s, d), 2, F.levenshtein).withColumn("distance", F.col("distance").cast("bigint")),
        f"WITH {VOC} SELECT query, word, levenshtein(query, word)::BIGINT AS distance FROM mq, voc WHERE levenshtein(query, word) <= 2",
    ),
    "deletion_variants_two": (lambda s, d: Z.variants(vocabulary(s, d).select("word"), "word", 2).distinct(), f"WITH {VOC}, one AS (SELECT word, unnest({DEL('word')}) AS v FROM voc) SELECT DISTINCT word, unnest({DEL('v')}) AS variant FROM one"),
    "prefix_similarity": (
        lambda s, d: t(s, d, "part").select("p_partkey", F.round(T.prefix_similarity(F.col("p_brand"), F.concat(F.col("p_brand").substr(1, 3), F.col("p_type"))), 6).alias("similarity")),
        "WITH x AS (SELECT p_partkey, p_brand AS a, p_brand[1:3] || p_type AS b FROM part), y AS (SELECT *, 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE AS sim, CASE WHEN length(a) >= 4 AND a[1:4] = b[1:4] THEN 4 WHEN length(a) >= 3 AND a[1:3] = b[1:3] THEN 3 ELSE least(length(a), 2) END AS k FROM x) SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 ELSE sim + k * 0.1 * (1 - sim) END, 6) AS similarity FROM y",
    ),
    "word_frequency": (lambda s, d: vocabulary(s, d), f"WITH {VOC} SELECT word, freq FROM voc"),
    "deletion_variants": (lambda s, d: Z.variants(vocabulary(s, d).select("word"), "word"), f"WITH {VOC} SELECT word, unnest({DEL('word')}) AS variant FROM voc"),
    "symspell_lookup": (
        lambda s, d: Z.deletion_lookup(misspelt(s, d), vocabulary(s, d)),
        f"WITH {VOC}, qv AS (SELECT DISTINCT query, unnest({DEL('query')}) AS v FROM mq), wv AS (SELECT word, freq, unnest({DEL('word')}) AS v FROM voc), h AS (SELECT DISTINCT query, word, freq FROM qv JOIN wv USING (v)) SELECT query, word, freq, row_number() OVER (PARTITION BY query ORDER BY freq DESC, word) AS rank FROM h",
    ),
    "radius_search": (
        lambda s, d: Z.radius_search(misspelt(s, d), vocabulary(s, d), 1).withColumn("distance", F.col("distance").cast("bigint")),
        f"WITH {VOC} SELECT query, word, damerau_levenshtein(query, word)::BIGINT AS distance FROM mq, voc WHERE damerau_levenshtein(query, word) <= 1",
    ),
    # near duplicates
    "shingle_counts": (lambda s, d: t(s, d, "documents").select("doc_id", F.size(T.shingles(F.col("text"))).cast("bigint").alias("n")), f"WITH {SHG('documents', 'doc_id', 3)}, c AS (SELECT id, count(*) AS n FROM sh GROUP BY id) SELECT doc_id, coalesce(n, 0) AS n FROM documents LEFT JOIN c ON id = doc_id"),
    "jaccard_pairs": (
        lambda s, d: D.similar_sets(t(s, d, "documents"), "doc_id", "text", members=True).select("a", "b", *R6("jaccard")),
        JACCARD,
    ),
    "containment_bench": (
        lambda s, d: D.overlaps(D.shingle_rows(t(s, d, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "id"), D.shingle_rows(t(s, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "id")).select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), *R6("jaccard", "containment")),
        f"WITH {SHG('documents', 'doc_id', 3)}, {SHG('benchmark', 'item_id', 3).replace('sw AS', 'bw AS').replace('sh AS', 'bs AS').replace('FROM sw', 'FROM bw')}, nd AS (SELECT id, count(*) AS n FROM sh GROUP BY id), nb AS (SELECT id, count(*) AS n FROM bs GROUP BY id), i AS (SELECT bs.id AS item_id, sh.id AS doc_id, count(*) AS c FROM bs JOIN sh USING (s) GROUP BY 1, 2) SELECT item_id, doc_id, round(c / (nb.n + nd.n - c)::DOUBLE, 6) AS jaccard, round(c / least(nb.n, nd.n)::DOUBLE, 6) AS containment FROM i JOIN nb ON nb.id = item_id JOIN nd ON nd.id = doc_id",
    ),
    "minhash_signature": (
        lambda s, d: D.minhash(t(s, d, "benchmark"), "item_id", "text").select("item_id", F.array_join("signature", ",").alias("signature")),
        f"WITH {SHG('benchmark', 'item_id', 3)}, {SIG('sh')} SELECT id AS item_id, array_to_string(sig, ',') AS signature FROM sg",
    ),
    "signature_agreement": (
        lambda s, d: agreements(s, d),
        f"WITH {SHG('benchmark', 'item_id', 3)}, {SIG('sh')} SELECT x.id AS a, y.id AS b, round(len(list_filter(range(1, 101), lambda i: x.sig[i] = y.sig[i])) / 100.0::DOUBLE, 6) AS agreement FROM sg x, sg y WHERE x.id % 100 = 0",
    ),
    "lsh_pairs": (
        lambda s, d: D.minhash_pairs(t(s, d, "documents"), "doc_id", "text"),
        f"WITH {DISTINCT}, {SHG('texts', 'id', 3)}, {SIG('sh')}, bd AS (SELECT id, b, array_to_string(sig[b * 5 + 1:b * 5 + 5], '|') AS k FROM sg, range(20) r(b)) SELECT DISTINCT x.id AS a, y.id AS b FROM bd x JOIN bd y ON x.b = y.b AND x.k = y.k AND x.id < y.id",
    ),
    "lsh_verified": (lambda s, d: D.lsh_similar(t(s, d, "documents"), "doc_id", "text", members=True).select("a", "b", *R6("jaccard")), JACCARD),
    # retrieval
    "inverted_index": (
        lambda s, d: B.postings(t(s, d, "documents"), "doc_id", "text").select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")),
        f"WITH {POST('documents', 'doc_id')} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM ps GROUP BY 1, 2",
    ),
    "corpus_stats": (lambda s, d: B.corpus_stats(B.lengths(t(s, d, "documents"), "doc_id", "text")).select("n_docs", "n_tokens", *R6("avg_len")), f"WITH {POST('documents', 'doc_id')} SELECT n AS n_docs, n_tokens::BIGINT AS n_tokens, round(avg_len, 6) AS avg_len FROM st"),
    "doc_freq": (lambda s, d: B.positions(t(s, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count_distinct("doc_id").alias("df")), f"WITH {POST('documents', 'doc_id')} SELECT term, df FROM df"),
    "tfidf_topk": (lambda s, d: ranked(s, d, "tfidf").where("rank <= 20").select("query_id", "doc_id", *R6("score"), "rank"), f"WITH {BM} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM tir WHERE rank <= 20"),
    "bm25_topk": (lambda s, d: ranked(s, d, "bm25").where("rank <= 20").select("query_id", "doc_id", *R6("score"), "rank"), f"WITH {BM} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 20"),
    "rrf_fusion": (
        lambda s, d: B.fuse(ranked(s, d, "bm25", True), ranked(s, d, "tfidf", True)).select("query_id", "doc_id", F.round("rrf", 8).alias("rrf")),
        f"WITH {BM} SELECT query_id, doc_id, round(sum(1.0 / (rank + 60)), 8) AS rrf FROM (SELECT query_id, doc_id, rank FROM bmr UNION ALL SELECT query_id, doc_id, rank FROM tir) GROUP BY 1, 2",
    ),
    "boolean_and": (
        lambda s, d: B.all_terms(t(s, d, "documents"), "doc_id", "text", B.query_terms(queries_of(s, d).select("query_id", F.substring_index("query", " ", 3).alias("query")))),
        f"WITH {POST('documents', 'doc_id')}, q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK("array_to_string(string_split(text, ' ')[1:3], ' ')")}) AS term FROM benchmark WHERE item_id % 100 = 0), n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1) SELECT query_id, doc_id FROM q JOIN tf USING (term) JOIN n USING (query_id) GROUP BY query_id, doc_id, n HAVING count(*) = n",
    ),
    "phrase_search": (
        lambda s, d: B.phrase(t(s, d, "documents"), "doc_id", "text", t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring_index("text", " ", 3).alias("query"))),
        f"WITH {POST('documents', 'doc_id')}, q AS (SELECT item_id AS query_id, {TOK("array_to_string(string_split(text, ' ')[1:3], ' ')")} AS q FROM benchmark), f AS (SELECT query_id, len(q) AS l, unnest(q) AS term, unnest(range(0, len(q))) AS pl FROM q), r AS (SELECT query_id, doc_id, pos - pl AS base, count(*) AS m, any_value(l) AS l FROM f JOIN ps USING (term) GROUP BY 1, 2, 3) SELECT query_id, doc_id, count(*) AS n FROM r WHERE m = l GROUP BY 1, 2",
    ),
    "synonym_search": (
        lambda s, d: B.search(t(s, d, "documents"), "doc_id", "text", B.expand(s.createDataFrame([(1, "thing"), (2, "und")], "query_id bigint, term string"), s.createDataFrame([("thing", "ention"), ("und", "oder"), ("und", "die")], "term string, synonym string"))).select("query_id", "doc_id", *R6("score")),
        f"WITH {POST('documents', 'doc_id')}, q(query_id, term) AS (VALUES (1::BIGINT, 'thing'), (1, 'ention'), (2, 'und'), (2, 'oder'), (2, 'die')) SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.25 / (tf + 1.25 * (0.2 + 0.8 * len(w) / avg_len))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN tk USING (doc_id), st GROUP BY 1, 2",
    ),
    # semantic
    "cosine_topk": (
        lambda s, d: S.cosine_topk(t(s, d, "embeddings").where("vec_id % 100 = 0"), t(s, d, "embeddings"), "vec_id", "embedding").select("query_id", "vec_id", *R6("cosine"), "rank"),
        "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), c AS (SELECT x.vec_id AS query_id, y.vec_id, list_sum(list_transform(range(1, 65), lambda i: x.v[i] * y.v[i])) / (sqrt(list_sum(list_transform(x.v, lambda z: z * z))) * sqrt(list_sum(list_transform(y.v, lambda z: z * z)))) AS c FROM e x, e y WHERE x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id) SELECT query_id, vec_id, round(c, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank FROM c) WHERE rank <= 10",
    ),
    "chunk_docs": (
        lambda s, d: S.chunk(t(s, d, "documents"), "doc_id", "text").select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk"),
        f"WITH w AS (SELECT doc_id, text, {WDS('text')} AS w FROM documents), c AS (SELECT doc_id, CASE WHEN len(w) <= 6 THEN [text] ELSE list_transform(range(0, ceil((len(w) - 6) / 4.0)::BIGINT + 1), lambda i: array_to_string(w[i * 4 + 1:i * 4 + 6], ' ')) END AS c FROM w) SELECT doc_id, unnest(range(0, len(c))) AS chunk_no, unnest(c) AS chunk FROM c",
    ),
    "best_sentence": (
        lambda s, d: S.best_sentence(t(s, d, "benchmark"), "item_id", "text", word_vectors(s, d), [1.0, 2.0, 0.0, 0.0, 1.0]).select("item_id", "sentence", *R6("score")),
        f"WITH {SEN}, dc AS (SELECT lower(sentence) AS k, arg_min(sentence, item_id) AS b FROM sn WHERE no = 0 GROUP BY 1), v AS (SELECT item_id, no, sentence, CASE WHEN b IS NULL THEN [0.1, 0.1, 0.1, 0.1, 0.1] ELSE [length(b), 1.0, 2.0, 0.0, 1.0] END::DOUBLE[] AS v FROM sn LEFT JOIN dc ON k = lower(sentence)), c AS (SELECT *, (v[1] + 2 * v[2] + v[5]) / (sqrt(6.0) * sqrt(list_sum(list_transform(v, lambda x: x * x)))) AS score FROM v) SELECT item_id, sentence, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, no) AS r FROM c) WHERE r = 1",
    ),
    "lexical_overlap": (
        lambda s, d: t(s, d, "part").select("p_partkey", S.lexical_overlap(F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand", F.substring_index("p_name", " ", 1))).cast("bigint").alias("n")),
        f"SELECT p_partkey, len(list_intersect({WDS('lower(p_name)')}, {WDS("lower(p_type || ' ' || p_brand || ' ' || string_split(p_name, ' ')[1])")})) AS n FROM part",
    ),
    "joined_words": (
        lambda s, d: numbered(t(s, d, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], ["p_partkey"], "i").groupBy("p_brand", F.floor((F.col("i") - 1) / 1000).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " ").alias("names")).select("p_brand", "page", F.md5("names").alias("names_md5")),
        "SELECT p_brand, page, md5(string_agg(p_name, ' ' ORDER BY p_partkey)) AS names_md5 FROM (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 1000 AS page FROM part) GROUP BY p_brand, page",
    ),
}
