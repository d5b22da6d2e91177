"""One query for each operator, over its whole tables, with the SQL that must give the same rows where SQL can say it."""
import os

from pyspark.sql import functions as F

from kinsift.llm import common

QUERIES, ORACLE = {}, {}

#: Fixed by the contract of op7.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: A public unigram-style vocabulary; read on the driver, never copied here.
VOCABULARY = os.environ.get("KINSIFT_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
#: White space and words in DuckDB's regular expressions.
SQL_WORD = r"'[^\x20\x09-\x0D]+'"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name, sql=None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return add


SQL_SHINGLES = """CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"""


@query("op1_ngram_jaccard_join", f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({SQL_LOWER.format("text")}, {SQL_WORD}) AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({SQL_SHINGLES}) AS s FROM d),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
    edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id
    FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = doc_id GROUP BY doc_id""")
def op1(spark, sf_dir):
    """Size of every document's shingle set, and the group of near copies it is in."""
    from kinsift.llm.ngram_join import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op2_lm_scoring")
def op2(spark, sf_dir):
    """Language-model scores of every document."""
    from kinsift.llm.lm_scoring import score

    return score(common.table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3(spark, sf_dir):
    """Words and tokens of every document."""
    from kinsift.llm.token_counts import count_tokens, read_pieces

    return count_tokens(common.table(spark, sf_dir, "documents"), read_pieces(VOCABULARY))


#: crc32 of the bytes in a list of UBIGINT, bit by bit: polynomial 0xEDB88320, reflected.
SQL_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, {}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT)"""
SQL_BYTES = "list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::UBIGINT)"


@query("op4_line_dedup", rf"""
    WITH d AS (SELECT doc_id, text, {SQL_LOWER.format("text")} AS low FROM documents WHERE text IS NOT NULL),
    lines AS (SELECT doc_id, unnest(string_split(low, chr(10))) AS line, generate_subscripts(string_split(low, chr(10)), 1) AS ln FROM d),
    split AS (SELECT doc_id, ln, regexp_extract_all(line, {SQL_WORD}) AS w FROM lines),
    spread AS (SELECT doc_id, ln, unnest(w) AS word, generate_subscripts(w, 1) AS k, len(w) AS m FROM split),
    marked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln, k) - 1 AS i, word,
                      k = m OR right(word, 1) IN ('.', '!', '?', ',', ';', ':') AS stop FROM spread),
    coarse AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM marked),
    sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, c) AS n FROM coarse),
    fine AS (SELECT *, stop OR (CASE WHEN n > 16 THEN {SQL_CRC.format(SQL_BYTES.format("word"))} % 8 = 0 ELSE false END) AS ends FROM sized),
    worded AS (SELECT doc_id, i, word, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS piece FROM fine),
    p AS (SELECT doc_id, piece, min(i) AS a, max(i) + 1 AS b FROM worded GROUP BY ALL),
    u AS (SELECT p.doc_id, p.piece, p.a, min(q.b) AS b FROM p JOIN p q ON q.doc_id = p.doc_id AND q.piece BETWEEN p.piece AND p.piece + 25 AND q.b >= p.a + 25 GROUP BY ALL),
    lists AS (SELECT doc_id, list(word ORDER BY i) AS ws FROM worded GROUP BY doc_id),
    k AS (SELECT u.*, array_to_string(ws[a + 1:b], ' ') AS norm FROM u JOIN lists USING (doc_id)),
    f AS (SELECT *, first_value(doc_id) OVER x AS fd, first_value(piece) OVER x AS fp, first_value(a) OVER x AS fa, first_value(b) OVER x AS fb FROM k
          WINDOW x AS (PARTITION BY norm ORDER BY doc_id, piece)),
    h AS (SELECT f.*, own.ws, other.ws AS fw, CASE WHEN f.doc_id = fd THEN fb ELSE 0 END AS low FROM f JOIN lists own ON own.doc_id = f.doc_id JOIN lists other ON other.doc_id = fd
          WHERE NOT (f.doc_id = fd AND piece = fp) AND (f.doc_id <> fd OR a >= fb)),
    g AS (SELECT doc_id, a + 1 - coalesce(list_filter(range(1, 9), lambda x: a - x < low OR fa < x OR ws[a - x + 1] <> fw[fa - x + 1])[1], 9) AS s,
                 b + coalesce(list_filter(range(0, 8), lambda x: b + x >= len(ws) OR fb + x >= len(fw) OR ws[b + x + 1] <> fw[fb + x + 1])[1], 8) AS e FROM h),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS i FROM g),
    raw AS (SELECT doc_id, regexp_extract(text, '^[\x20\x09-\x0D]*') AS lead, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS toks FROM d),
    t AS (SELECT doc_id, lead, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS i FROM raw),
    placed AS (SELECT *, length(lead) + coalesce(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS opens FROM t),
    st AS (SELECT placed.*, gone.i IS NOT NULL AS out, placed.i - row_number() OVER (PARTITION BY placed.doc_id, gone.i IS NOT NULL ORDER BY placed.i) AS island
           FROM placed LEFT JOIN gone ON gone.doc_id = placed.doc_id AND gone.i = placed.i),
    spans AS (SELECT doc_id, count(*)::INT AS n, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM (
              SELECT doc_id, min(opens) AS s, max(opens + length(tok)) AS e FROM st WHERE out GROUP BY doc_id, island) GROUP BY doc_id),
    kept AS (SELECT doc_id, any_value(lead) || coalesce(string_agg(tok, '' ORDER BY i) FILTER (NOT out), '') AS body FROM st GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::INT AS n_removed, coalesce(spans, '') AS removed_spans, coalesce(body, text) AS text, length(text)::BIGINT AS original_chars
    FROM documents LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op4(spark, sf_dir):
    """Every document without the passages that an earlier one (or itself) has, and where they stood, in code points of the original."""
    from kinsift.llm.line_dedup import dedup_units

    out = dedup_units(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"], r["end"])), ",")
    return out.select("doc_id", F.size("removed").alias("n_removed"), spans.alias("removed_spans"), "text", "original_chars")


@query("op5_benchmark_decontamination", f"""
    WITH d AS (SELECT doc_id AS id, regexp_extract_all({SQL_LOWER.format("text")}, {SQL_WORD}) AS w FROM documents),
    b AS (SELECT item_id AS id, regexp_extract_all({SQL_LOWER.format("text")}, {SQL_WORD}) AS w FROM benchmark),
    ds AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
    bs AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
    m AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
    SELECT ds.id AS doc_id, bs.id AS item_id, count(*)::INT AS n_shared, any_value(m.n)::INT AS n_item, count(*) / any_value(m.n) AS containment
    FROM bs JOIN ds USING (s) JOIN m ON m.id = bs.id GROUP BY ds.id, bs.id HAVING 100 * count(*) >= 75 * any_value(m.n)""")
def op5(spark, sf_dir):
    """Documents that contain a benchmark item, with the item."""
    from kinsift.llm.decontaminate import contained_items

    return contained_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@query("op6_html_extraction")
def op6(spark, sf_dir):
    """Main text of every page."""
    from kinsift.llm.html_extract import extract

    return extract(common.table(spark, sf_dir, "pages"))


@query("op7_url_filters", f"""
    WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, {SQL_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
    fit AS (SELECT page_id, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) AS place
            FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
    SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
    FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND place = 1""")
def op7(spark, sf_dir):
    """Verdict of every page's URL."""
    from kinsift.llm.url_filters import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op8_mixing")
def op8(spark, sf_dir):
    """Words that the mix takes of every document."""
    from kinsift.llm.mixing import mix
    from kinsift.session import materialise

    documents = common.table(spark, sf_dir, "documents")
    sized = materialise(documents.select("doc_id", "source", common.n_words(F.col("text")).alias("size")))
    return mix(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


@query("op9_quality_rules")
def op9(spark, sf_dir):
    """Base counts of every document, and whether it is kept."""
    from kinsift.llm.quality_rules import score

    out = score(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("f_words").alias("n_words"), F.col("f_chars").alias("word_chars"), F.col("f_symbols").alias("n_symbols"),
                      F.col("f_dup_lines").alias("n_dup_lines"), F.col("f_repeat").alias("n_repeat_words"), "base_failed", "kept",
                      F.round("quality", 6).alias("quality"))


@query("op10_license_scan")
def op10(spark, sf_dir):
    """License wordings in every document."""
    from kinsift.llm.license_scan import scan_licenses

    return scan_licenses(common.table(spark, sf_dir, "documents"))


def _tree_sql():
    """Levels of a tree of `name`(grp, idx, n, h), one row a node, and the path of every node: H of a run is sha256 of its digests in order."""
    def levels(name):
        return f"""{name}_tree AS (
            SELECT grp, 0 AS level, idx, n, h FROM {name}
            UNION ALL
            SELECT grp, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM {name}_tree WHERE n > 1
            GROUP BY grp, level, idx // 16, n)"""

    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = SQL_CRC.format(SQL_BYTES.format("doc_id::VARCHAR"))
    return f"""
    WITH RECURSIVE raw AS (SELECT coalesce('=' || source, '') AS grp, doc_id, {leaf("text")} AS h, {crc} % 5 = 0 AS hit,
                                  {leaf("low")} AS other
                           FROM (SELECT *, {SQL_LOWER.format("text")} AS low FROM documents)),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM raw),
    {levels("leaves")},
    tops AS (SELECT row_number() OVER (ORDER BY grp) - 1 AS idx, grp AS src, h, count(*) OVER () AS n, 0 AS grp FROM leaves_tree WHERE n = 1),
    {levels("tops")},
    root AS (SELECT h AS root FROM tops_tree WHERE n = 1),
    heights AS (SELECT grp, max(level) AS height FROM leaves_tree GROUP BY grp),
    steps AS (
        SELECT grp AS src, 0 AS part, level, idx, string_agg(h, '' ORDER BY idx) OVER before AS pre, string_agg(h, '' ORDER BY idx) OVER after AS post
        FROM leaves_tree WHERE n > 1
        WINDOW before AS (PARTITION BY grp, level, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               after AS (PARTITION BY grp, level, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    top_steps AS (
        SELECT level, idx, string_agg(h, '' ORDER BY idx) OVER before AS pre, string_agg(h, '' ORDER BY idx) OVER after AS post
        FROM tops_tree WHERE n > 1
        WINDOW before AS (PARTITION BY level, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               after AS (PARTITION BY level, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    path AS (
        SELECT l.grp, l.idx, s.level, coalesce(s.pre, '') AS pre, coalesce(s.post, '') AS post
        FROM leaves l JOIN steps s ON s.src = l.grp AND s.idx = l.idx // (16 ** s.level)::BIGINT
        UNION ALL
        SELECT l.grp, l.idx, height + s.level, coalesce(s.pre, ''), coalesce(s.post, '')
        FROM leaves l JOIN heights USING (grp) JOIN tops t ON t.src = l.grp JOIN top_steps s ON s.idx = t.idx // (16 ** s.level)::BIGINT),
    proofs AS (SELECT grp, idx, string_agg(pre || post, '' ORDER BY level) AS proof, max(level) + 1 AS steps FROM path GROUP BY grp, idx),
    fold AS (
        SELECT grp, idx, 0 AS level, CASE WHEN hit THEN other ELSE h END AS now FROM leaves
        UNION ALL
        SELECT f.grp, f.idx, f.level + 1, sha256(pre || now || post) FROM fold f JOIN path p ON p.grp = f.grp AND p.idx = f.idx AND p.level = f.level)
    SELECT l.doc_id, CASE WHEN l.grp <> '' THEN substr(l.grp, 2) END AS source, l.h AS leaf, t.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
           f.now AS folded_root, f.now = root AS verified
    FROM leaves l JOIN tops t ON t.src = l.grp CROSS JOIN root LEFT JOIN proofs p ON p.grp = l.grp AND p.idx = l.idx
    JOIN fold f ON f.grp = l.grp AND f.idx = l.idx AND f.level = coalesce(steps, 0)"""


@query("op12_merkle_manifest", _tree_sql())
def op12(spark, sf_dir):
    """Leaf, roots and proof of every document, and whether what was found later still gives the root."""
    from kinsift.llm.merkle import manifest

    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, common.lower_ascii(F.col("text")))
    return manifest(common.table(spark, sf_dir, "documents"), found={"text": lowered})


def _rounds_sql(k=40, rounds=5, size=64):
    """Rounds of assignment and mean, one after the other, each over all vectors and all centroids."""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v)",
             f"""c0 AS MATERIALIZED (SELECT place - 1 AS c, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM (
                   SELECT v, row_number() OVER (ORDER BY vec_id IS NULL, sha256('2:' || vec_id), v) AS place FROM v) WHERE place <= {k})"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (
                   SELECT r, c, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.y, o.y) AS y FROM c{n} o LEFT JOIN (
                   SELECT a.best.c AS c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS y FROM a{n} a JOIN x USING (r) GROUP BY ALL) m USING (c, i))""")
    return "WITH " + ", ".join(parts) + f"""
    SELECT vec_id, a.best.c::INT AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY a.best.c)::BIGINT AS cluster_inertia, sum(a.best.d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
    FROM a{rounds} a JOIN v USING (r) JOIN (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) hashed ON hashed.c = a.best.c"""


@query("op13_centroid_clusters", _rounds_sql())
def op13(spark, sf_dir):
    """Nearest centroid of every whole vector after five rounds."""
    from kinsift.llm.centroid_clusters import cluster

    return cluster(common.table(spark, sf_dir, "embeddings"))


@query("op11_quality_classifier")
def op11(spark, sf_dir):
    """Quality of every document."""
    from kinsift.llm.quality_net import score_quality

    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
