"""The thin opN queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.conversation_repair import conversation_digests, damage_conversations, repair_conversations
from strata.llm.divergence import audit_sources
from strata.llm.exact_dedup import exact_groups
from strata.llm.lm_scoring import score_texts
from strata.llm.mixing import mix_sources
from strata.llm.ngram_join import join_similar
from strata.llm.packing import pack_documents
from strata.llm.quality_classifier import classify_quality
from strata.llm.quality_rules import quality_rules
from strata.llm.substring_dedup import drop_repeated_windows
from strata.llm.suffix_dedup import drop_repeated_strings
from strata.llm.toxicity import score_toxicity
from strata.llm.url_filter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_strings(table(spark, sf_dir, "documents"), width=100)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed_from").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    """The vocabulary that the driver's contract names; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, capacity=4096)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_windows(table(spark, sf_dir, "documents"), width=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


#: Production weights of the mixture: the large source seven times any other.
MIX_WEIGHTS = {"src0": 7}


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs, MIX_WEIGHTS)


#: (verdict, host, path prefix)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which no row is left after the damage have nothing to repair."""
    given = table(spark, sf_dir, "conversations")
    found = conversation_digests(repair_conversations(damage_conversations(given))).withColumnRenamed("conv_id", "id")
    every = given.select("conv_id").distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.join(found, every["conv_id"].eqNullSafe(found["id"]), "left").select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"), least_docs=30, top=50)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_packing": op2_packing,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_toxicity": op12_toxicity,
    "op13_divergence": op13_divergence,
}

def _repair_sql() -> str:
    """The cheapest edits by a fold from the last row to the first: cost, letters and text for each position (start, after system, after user, after assistant)."""
    row = lambda q, due, name: f"""list_min([{{'c': 2 + v[{q}].c, 'a': 'D' || v[{q}].a, 't': v[{q}].t}}] || CASE WHEN f IN ('blank', 'duplicate') THEN []::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)[] ELSE [{{'c': 1 + late + v[{due}].c, 'a': 'R' || v[{due}].a, 't': chr(10) || '{name}:' || x || v[{due}].t}}] || {{kept}} END)"""
    keep = lambda *pairs: "(CASE i " + " ".join(f"WHEN '{i}' THEN [{{'c': late + v[{to}].c, 'a': 'K' || v[{to}].a, 't': chr(10) || role || ':' || x || v[{to}].t}}]" for i, to in pairs) + " ELSE [] END)"
    before = [row(1, 3, "user").replace("{kept}", keep(("s", 2), ("u", 3))), row(2, 3, "user").replace("{kept}", keep(("u", 3))), row(3, 4, "assistant").replace("{kept}", keep(("a", 4))), row(4, 3, "user").replace("{kept}", keep(("u", 3)))]
    more = lambda v, to, name: f"{{'c': 5 + {v}[{to}].c, 'a': 'I' || {v}[{to}].a, 't': chr(10) || '{name}:' || {v}[{to}].t}}"
    shut = lambda v: "[" + ", ".join(f"least({v}[{q}], {more(v, to, name)})" for q, to, name in ((1, 3, "user"), (2, 3, "user"), (3, 4, "assistant"), (4, 3, "user"))) + "]"
    crc = "list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: list_concat([ord(s)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END) END)"
    return rf"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, row_number() OVER () AS id, coalesce(role, ' ') AS role, coalesce(text, ' ') AS x, xor({crc}, 4294967295::BIGINT) % 20 AS k FROM conversations),
        d AS (SELECT coalesce('=' || conv_id::VARCHAR, '') AS g, turn, id, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS x,
              unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
        b AS (SELECT *, left(role, 1) AS i, regexp_replace(x, '[ 	-
]+$', '') AS bare, row_number() OVER w AS n, lag(left(role, 1)) OVER w AS was, row_number() OVER (PARTITION BY g, role, x ORDER BY turn NULLS FIRST, id, copy) AS seen
              FROM d WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(x), id, copy)),
        r AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f FROM b),
        s AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
              count(*) FILTER (f = 'truncated') AS truncated, count(*) FILTER (n > 1 AND was || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
        e AS (SELECT [{{'c': 0::BIGINT, 'a': '', 't': ''}}, {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': 5, 'a': 'I', 't': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 't': ''}}] AS v),
        p(g, n, v) AS (
            SELECT s.g, s.n, e.v FROM s, e
            UNION ALL
            SELECT g, n - 1, {shut("v")} FROM (SELECT g, n, {shut("v")} AS v FROM (
                SELECT g, n, [{", ".join(before)}] AS v FROM (SELECT p.g, p.n, p.v, r.f, r.i, r.role, r.x, CASE WHEN r.f = 'truncated' THEN 5 ELSE 0 END AS late FROM p JOIN r ON r.g = p.g AND r.n = p.n)))),
        o AS (SELECT s.*, p.v[1] AS o FROM s JOIN p ON p.g = s.g AND p.n = 0)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(o.o.c, 0)::BIGINT AS cost, coalesce(o.o.a, '') AS audit, sha256(substr(coalesce(o.o.t, ''), 2)) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN o ON o.g = coalesce('=' || c.conv_id::VARCHAR, '')"""


ORACLE = {
    "op11_conversation_repair": _repair_sql(),
    "op13_divergence": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
        l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
        g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
                     1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
              FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50""",
    "op1_suffix_dedup": r"""
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 99)) AS i FROM h)),
        f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1 AS dead FROM w),
        b AS (SELECT doc_id, unnest(regexp_extract_all(x, '..')) AS byte, unnest(range(length(x) // 2)) AS i FROM h),
        g AS (SELECT b.doc_id, b.i, byte, coalesce(max(CASE WHEN dead THEN b.i END) OVER (PARTITION BY b.doc_id ORDER BY b.i) > b.i - 100, false) AS gone FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.i = b.i),
        r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM g),
        k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY 1)
        SELECT h.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN k USING (doc_id)""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_mix_sources": """
        WITH RECURSIVE sizes AS (
            SELECT coalesce(source, '') AS source, count(*) AS n, CASE WHEN coalesce(source, '') = 'src0' THEN 7 ELSE 1 END AS weight
            FROM documents GROUP BY 1),
        total AS (SELECT sum(weight)::BIGINT AS p FROM sizes),
        slots(t, had, picked) AS (
            SELECT -1::BIGINT, (SELECT map_from_entries(list({k: source, v: 0::BIGINT})) FROM sizes), NULL::VARCHAR
            UNION ALL
            SELECT t + 1, map_from_entries(list_transform(map_entries(had), lambda e: {k: e.key, v: e.value + CASE WHEN e.key = pick THEN 1 ELSE 0 END})), pick
            FROM (SELECT t, had, (SELECT s.source FROM sizes s WHERE (had[s.source] * p) // s.weight <= t + 1
                                  ORDER BY ((had[s.source] + 1) * p + s.weight - 1) // s.weight, s.weight DESC, s.source LIMIT 1) AS pick, p
                  FROM slots, total) WHERE t + 1 < p),
        plan AS (SELECT t AS slot, picked AS source, row_number() OVER (PARTITION BY picked ORDER BY t) - 1 AS turn FROM slots WHERE t >= 0),
        ends AS (SELECT min((n // 8 // weight) * p + slot) AS e FROM sizes, total, plan
                 WHERE plan.source = sizes.source AND turn = (n // 8) % weight),
        numbered AS (SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id NULLS FIRST) - 1 AS i FROM documents),
        placed AS (
            SELECT doc_id, numbered.source, i, i // 8 AS block, weight, p, n, plan.slot
            FROM numbered JOIN sizes ON sizes.source = s CROSS JOIN total
            JOIN plan ON plan.source = s AND turn = (i // 8) % weight)
        SELECT doc_id, source, (block // weight) * p + slot AS mix_slot, i % 8 AS mix_offset,
               (block * p) // weight AS mix_release, ((block + 1) * p + weight - 1) // weight AS mix_due,
               (block // weight) * p + slot < e AS in_mix
        FROM placed, ends""",
    "op3_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        f AS (SELECT g, count(*) AS k FROM s GROUP BY 1 HAVING count(*) > 1),
        r AS (SELECT s.doc_id, s.g FROM s JOIN f USING (g)),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        p(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.doc_id, l.b FROM p JOIN l ON l.a = p.reached)
        SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(p.reached) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN p ON p.doc_id = d.doc_id GROUP BY 1""",
    "op5_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
        f AS (SELECT t, min(doc_id) AS first_doc FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
        x AS (SELECT DISTINCT s.doc_id, s.i + unnest(range(0, 50)) AS i FROM s JOIN f USING (t) WHERE f.first_doc < s.doc_id),
        k AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
        o AS (SELECT k.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY k.i) AS t FROM k ANTI JOIN x ON k.doc_id = x.doc_id AND k.i = x.i GROUP BY 1)
        SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)""",
}
