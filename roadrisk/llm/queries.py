"""Registered queries over the test tables, and reference SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadrisk.llm import bpe, decontaminate, divergence, embeddings, infill, jaccard, licences, packing, pii, shards, substrings, toxicity, urls
from roadrisk.llm.shared import table


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.report(toxicity.scored(docs, toxicity.model_of(docs, table(spark, folder, "labels"))))


def op2_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.placed(table(spark, folder, "documents"))


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.groups(table(spark, folder, "documents"))


def op4_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scanned(table(spark, folder, "documents"))


def op5_embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.linked(table(spark, folder, "embeddings"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.report(substrings.deduplicated(table(spark, folder, "documents")))


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(decontaminate.search(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(pii.protected(table(spark, folder, "documents")))


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe.encoded(table(spark, folder, "documents").select("doc_id", "text"))
    return bpe.report(bpe.decoded(rows.select(F.struct("row.doc_id").alias("row"), "ids")))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill.report(infill.cut(table(spark, folder, "documents").select("doc_id", "text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_hilbert_shards, op3_jaccard_join, op4_licences, op5_embedding_neardup, op6_substring_dedup,
        op7_best_fit_packing, op8_decontamination, op9_url_filter, op10_pii, op11_divergence, op12_byte_bpe,
        op13_fill_in_middle,
    )
}

# --- reference SQL ---------------------------------------------------------------------------------

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_step(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


def _crc32(text: str) -> str:
    """CRC-32 of a text's bytes: one table step for each byte."""
    steps = f"[{', '.join(f'{_crc_step(k)}::BIGINT' for k in range(256))}]"
    digit = "instr('0123456789ABCDEF', h[{}]) - 1"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: (({digit.format(1)}) * 16 + {digit.format(2)})::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, ({steps})[(xor(c, b) & 255) + 1])))"


def _hilbert_sql() -> str:
    bits, axes = shards.BITS, [f"x{k}" for k in range(shards.DIMENSIONS)]
    mask, text = (1 << bits) - 1, "c"
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for axis in axes:
            if axis == "x0":
                text = f"(SELECT * REPLACE (CASE WHEN x0 & {bit} <> 0 THEN xor(x0, {below}) ELSE x0 END AS x0) FROM {text})"
            else:
                swap = f"(SELECT *, CASE WHEN {axis} & {bit} <> 0 THEN 0 ELSE xor(x0, {axis}) & {below} END AS t FROM {text})"
                text = f"(SELECT * EXCLUDE (t) REPLACE (CASE WHEN {axis} & {bit} <> 0 THEN xor(x0, {below}) ELSE xor(x0, t) END AS x0, xor({axis}, t) AS {axis}) FROM {swap})"
    for before, axis in zip(axes, axes[1:], strict=False):
        text = f"(SELECT * REPLACE (xor({axis}, {before}) AS {axis}) FROM {text})"
    turn = "0::BIGINT"
    for level in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN {axes[-1]} & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    text = f"(SELECT * REPLACE ({', '.join(f'xor({a}, t) AS {a}' for a in axes)}) FROM (SELECT *, {turn} AS t FROM {text}))"
    curve = "0::BIGINT"
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            curve = f"({curve} * 2 + (({axis} >> {level}) & 1))"
    cell = f"least({mask}, (length(bin(size)) - 5) * 4 + ((size >> (length(bin(size)) - 3)) & 3))::BIGINT"
    return f"""
WITH b AS (SELECT doc_id, (coalesce(strlen(text), 0) + {shards.OVERHEAD})::BIGINT AS size, coalesce({_crc32("text")}, 0) AS text_crc32, source, lang FROM documents),
g AS (SELECT min(doc_id) AS least, ((max(doc_id) - min(doc_id)) >> {bits}) + 1 AS step FROM b),
c AS (SELECT doc_id, size, text_crc32, coalesce({_crc32("source")}, 0) & {mask} AS x0, coalesce({_crc32("lang")}, 0) & {mask} AS x1,
             {cell} AS x2, coalesce(least((doc_id - least) // step, {mask}), 0)::BIGINT AS x3 FROM b, g),
h AS (SELECT doc_id, size, text_crc32, {curve} AS curve FROM {text}),
o AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, size, doc_id) - 1 AS place, count(*) OVER () AS total FROM h),
s AS (SELECT *, (place * {shards.SHARDS}) // total AS shard FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot,
       NULL::INT AS grown_shard, curve FROM s"""


def _canonical_sql(text: str) -> str:
    plain = rf"regexp_replace(lower(coalesce({text}, '')), '(?m)^\W*(?:copyright\b|\(c\)|©)[^\n]*$', ' ', 'g')"
    plain = rf"' ' || trim(regexp_replace({plain}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
    for other, one in licences.SPELLINGS:
        plain = f"replace({plain}, ' {other} ', ' {one} ')"
    return f"trim({plain})"


def _licences_sql() -> str:
    def named(text: str) -> str:
        whens = " ".join(f"WHEN {_canonical_sql(_quoted(known))} THEN '{name}'" for name, known in licences.KNOWN)
        return f"CASE {_canonical_sql(text)} {whens} END"

    return f"""
WITH d AS (SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x)) > 0) AS lines FROM documents)
SELECT doc_id, text_digest, licence, coalesce(found, '') AS notices, n_lines FROM (
SELECT doc_id, sha256({_canonical_sql("text")}) AS text_digest, {named("text")} AS licence,
       list_aggregate(list_sort(list_distinct(list_filter(list_transform(lines, lambda x: {named("x")}), lambda x: x IS NOT NULL))), 'string_agg', ',') AS found,
       len(lines)::INT AS n_lines
FROM d)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, k, k + 3) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(root) AS root FROM r GROUP BY 1) m USING (doc_id)"""

_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
                     WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS root FROM embeddings UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x),
m AS (SELECT x AS vec_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT m.vec_id, (SELECT count(*) FROM l WHERE l.x = m.vec_id) AS n_links, component_id, m.vec_id = component_id AS kept FROM m"""

_SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, k, list_slice(w, k, k + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
f AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY g) AS least FROM x) WHERE doc_id > least),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS place FROM f),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.place) AS kept, count(*) AS n
      FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.place = t.place WHERE c.place IS NULL GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

_DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, k, k + least(len(w), 10) - 1) AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM p),
x AS (SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.k, x.n, p.item_id FROM x JOIN p ON x.n = p.n AND x.g = p.g),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)"""

_DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER.replace("text", "coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN t USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q
      FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY 1) USING (lang) GROUP BY 1, 2),
s AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200"""

_FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

SQL = {
    "op2_hilbert_shards": _hilbert_sql(),
    "op3_jaccard_join": _JACCARD,
    "op4_licences": _licences_sql(),
    "op5_embedding_neardup": _EMBEDDINGS,
    "op6_substring_dedup": _SUBSTRINGS,
    "op8_decontamination": _DECONTAMINATION,
    "op11_divergence": _DIVERGENCE,
    "op13_fill_in_middle": _FILL_IN_MIDDLE,
}
