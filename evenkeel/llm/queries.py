"""Thin queries over the operators of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import decontaminate, golden, htmlcut, langid, licenses, lmscore, merkle, packing, repair, secretscan, simhash, tiff, topk
from evenkeel.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.close_groups(spark, _table(spark, sf_dir, "documents"), size=3)
    return made.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, c = decontaminate.decontaminate(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.col(f"{c}.item_ids")
    return found.select("doc_id", f"{c}.n_words", f"{c}.n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col(f"{c}.n_hit") > 0).alias("contaminated"))


def op3_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), lmscore.held_out()
    scratch = Scratch(spark, "lmscore")
    model = lmscore.train(spark, scratch, docs.where(~held))
    made, c = lmscore.score(spark, docs, model, scratch, keep=["doc_id"])
    return made.select("doc_id", held.alias("held_out"), f"{c}.n_tokens", f"{c}.n_known", F.lit(model.totals.tokens).cast("long").alias("train_tokens"), f"{c}.base_score", f"{c}.score")


def spans_digest(spans, kinds: list[str], only: int | None = None):
    """kind:start:end of the spans (the first `only` kinds), comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in kinds])
    kept = spans if only is None else F.filter(spans, lambda s: s["rank"] < only)
    return F.array_join(F.transform(kept, lambda s: F.concat(F.element_at(names, s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secretscan.BASE + secretscan.MORE
    kinds = [r.kind for r in rules]
    made, c = secretscan.scan(spark, _table(spark, sf_dir, "documents"), rules, keep=["doc_id"])
    count = lambda k: F.size(F.filter(c, lambda s: s["rank"] == k)).cast("long").alias(f"n_{kinds[k]}")
    return made.select("doc_id", count(0), count(1), count(2), F.sha2(spans_digest(F.col(c), kinds, 3), 256).alias("base_sha256"), spans_digest(F.col(c), kinds).alias("spans"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = licenses.scan(spark, _table(spark, sf_dir, "documents"))
    base = F.array_sort(F.transform("hits", lambda h: h["label"]))
    return made.select(
        "doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["n"]).alias("n_base"),
        F.array_min(F.transform("hits", lambda h: h["before"])).alias("first_word"),
        (F.col("n_words") - F.array_min(F.transform("hits", lambda h: h["after"]))).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, "labels")), ",").alias("labels"), "score",
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pack(spark, _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op7_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = repair.write(spark, _table(spark, sf_dir, "documents"), Scratch(spark, "repair"), tokenizer_path("word_bpe_49k.json"))
    return repair.read(spark, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, c = tiff.store(spark, _table(spark, sf_dir, "documents"), keep=["doc_id"])
    media, payload = F.col(f"{c}.media"), F.col(f"{c}.payload")
    length = lambda x: F.octet_length(x).cast("long")
    return made.select("doc_id", f"{c}.n_bytes", length(payload).alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"), length(media).alias("media_bytes"), F.sha2(media, 256).alias("media_sha256"), f"{c}.feature")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    made, c = langid.identify(spark, docs, langid.train(spark, docs, ~held), keep=["doc_id"])
    return made.select("doc_id", held.alias("held_out"), f"{c}.lang_pred", f"{c}.score", f"{c}.rejected")


def op10_htmlcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, c = htmlcut.main_text(spark, _table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return made.select("page_id", "url", f"{c}.text", f"{c}.n_chars")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(even & F.contains(F.col("text"), F.lit("\n")), fields(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", fields(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    made, c = merkle.prove(spark, docs, "source", "doc_id", "leaf")
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col(f"{c}.path"))
    proofs = made.select("doc_id", "leaf", f"{c}.subroot", f"{c}.root", F.sha2(merkle.proof(F.col(f"{c}.path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = topk.top_k(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
    return made.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = golden.survivors(spark, _table(spark, sf_dir, "clients"))
    return made.select("cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", golden.cents(F.col("balance")).alias("balance_cents"), "name_from", "email_from", "segment_from", "balance_from", "address_from")


def queries() -> dict:
    made = (op1_simhash, op2_decontaminate, op3_lmscore, op4_secrets, op5_licenses, op6_packing, op7_repair, op8_tiff, op9_langid, op10_htmlcut, op11_merkle, op12_topk, op13_golden)
    return {f.__name__: f for f in made}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), " + _AZ + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS k, unnest([array_to_string(w[i:i + 9], ' ') FOR i IN range(1, greatest(1, CAST(len(w) AS BIGINT) - 9) + 1)]) AS pat FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (SELECT doc_id, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i, w FROM d, sizes WHERE len(w) >= k),
hits AS (SELECT g.doc_id, g.i, g.k, win.item FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS pat FROM grams) g JOIN win USING (k, pat)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(cover.n_hit, 0) AS n_hit, CAST(coalesce(len(items.ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items.ids, ','), '')) AS items_sha256, coalesce(cover.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def _rule_sql(rank: int, rule: secretscan.Rule) -> str:
    p = rule.pattern.replace("'", "''")
    held = f"list_transform(regexp_extract_all(t, '{p}', {rule.group}), lambda x: len(x))"
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest([{{'s': list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0), 'n': len(hits[i]), 'held': held[i]}} FOR i IN range(1, len(hits) + 1)]) AS m, {rule.least} AS least
FROM (SELECT doc_id, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS hits, {held} AS held FROM d WHERE regexp_matches(t, '{p}'))"""


_RULES_SQL = "\nUNION ALL\n".join(_rule_sql(i, r) for i, r in enumerate(secretscan.BASE + secretscan.MORE))
OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_RULES_SQL}),
spans AS (SELECT doc_id, rank, CAST(m.s AS BIGINT) AS s, concat_ws(':', kind, CAST(m.s AS BIGINT), CAST(m.s + m.n AS BIGINT)) AS label FROM found WHERE m.held >= least),
told AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(label, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(label, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""

_PHRASES_SQL = " UNION ALL ".join(f"SELECT '{label}' AS label, {p.split()} AS p" for p, label in licenses.PHRASES)
_SETS_SQL = " UNION ALL ".join(f"SELECT '{label}' AS label, {words} AS words, {need} AS need, {reach} AS reach" for label, words, need, reach in licenses.template_sets())
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
phrases AS ({_PHRASES_SQL}),
places AS (SELECT doc_id, label, i - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) + 1)) AS i FROM d) JOIN phrases ON w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS ls FROM places GROUP BY doc_id),
sets AS ({_SETS_SQL}),
pieces AS (SELECT doc_id, i, {_WORDS.replace("text", "b")} AS w FROM (SELECT doc_id, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i, unnest(string_split(t, chr(10))) AS b FROM d)),
lines AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM pieces WHERE len(w) > 0),
runs AS (SELECT a.doc_id, a.k, reach, list_distinct(flatten(list(b.w))) AS bw FROM lines a JOIN lines b ON a.doc_id = b.doc_id JOIN (SELECT DISTINCT reach FROM sets) r ON b.k >= a.k AND b.k <= a.k + reach AND (b.k = a.k OR b.upto - len(b.w) - a.upto < reach - 1) GROUP BY 1, 2, 3),
hits AS (SELECT doc_id, label, len(list_intersect(bw, words)) / len(words) AS share FROM runs JOIN sets USING (reach) WHERE len(bw) >= need AND len(list_intersect(bw, words)) >= need),
own AS (SELECT doc_id, list(DISTINCT label) AS ls, max(share) AS score FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base.ls, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(own.ls, [])))), ','), '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""

_FIELD = "coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x=c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_BIT = "(CASE WHEN r & 1 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)"
_CRC = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda r, i: {_BIT}, xor(c, b)), 4294967295), 4294967295)"
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format(text='text')} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} END AS tampered FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d),
low(tree, k, i, n, hash, run) AS (
  SELECT tree, 0, i, n, leaf, CAST([] AS VARCHAR[]) FROM numbered
  UNION ALL
  SELECT tree, k + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY i)), list(hash ORDER BY i) FROM low WHERE n > 1 GROUP BY tree, k, i // 3),
high(k, i, n, hash, run) AS (
  SELECT 0, tree, count(*) OVER (), hash, CAST([] AS VARCHAR[]) FROM low WHERE n = 1
  UNION ALL
  SELECT k + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(hash, '' ORDER BY i)), list(hash ORDER BY i) FROM high WHERE n > 1 GROUP BY k, i // 3),
tops AS (SELECT tree, k AS height, hash AS subroot FROM low WHERE n = 1),
way(doc_id, leaf, tree, k, i, cur, proof) AS (
  SELECT doc_id, leaf, tree, 0, i, coalesce(tampered, leaf), '' FROM numbered
  UNION ALL
  SELECT w.doc_id, w.leaf, w.tree, w.k + 1, p.i, sha256(array_to_string(list_concat(run[1:pos], [cur], run[pos + 2:len(run)]), '')), proof || array_to_string(list_concat(run[1:pos], run[pos + 2:len(run)]), '')
  FROM (SELECT way.*, CASE WHEN k < height THEN i % 3 ELSE CASE WHEN k = height THEN way.tree % 3 ELSE i % 3 END END AS pos, CASE WHEN k = height THEN way.tree ELSE i END AS here, height FROM way JOIN tops USING (tree)) w
  JOIN (SELECT tree, k, i, run, 'low' AS part FROM low WHERE k > 0 UNION ALL SELECT tops.tree, height + h.k, h.i, h.run, 'high' FROM high h, tops WHERE h.k > 0) p ON p.tree = w.tree AND p.k = w.k + 1 AND p.i = here // 3 AND p.part = CASE WHEN w.k < height THEN 'low' ELSE 'high' END)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM way JOIN tops USING (tree), (SELECT k AS more, hash AS root FROM high WHERE n = 1) WHERE way.k = height + more
"""

OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored) WHERE rank <= 10
"""

_RECENT = "updated_at DESC NULLS LAST, trust DESC, client_id NULLS LAST"
_TRUSTED = f"stale, trust DESC, {_RECENT}"
_KEPT = "CASE WHEN regexp_matches({c}, '[^\\x20\\x09-\\x0D]') THEN {c} END AS {c}"


def _first(field: str, order: str) -> str:
    return f"(list({{'v': {field}, 'id': client_id}} ORDER BY {order}, {field} DESC) FILTER ({field} IS NOT NULL))[1]"


OP13_SQL = f"""
WITH c AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, nation_id, CASE WHEN isfinite(balance) THEN balance END AS balance,
  CASE source WHEN 'partner' THEN 4 WHEN 'store' THEN 3 WHEN 'web' THEN 2 WHEN 'crm' THEN 1 ELSE 0 END AS trust, {', '.join(_KEPT.format(c=x) for x in ('name', 'email', 'segment', 'city'))} FROM clients),
d AS (SELECT *, coalesce(max(updated_at) OVER (PARTITION BY cluster_id) - updated_at > INTERVAL 720 HOUR, true) AS stale FROM c),
f AS (SELECT cluster_id, count(*) AS n_records, count(*) FILTER (stale) AS n_stale, {_first('name', 'len(name) DESC, ' + _TRUSTED)} AS name, {_first('email', _TRUSTED)} AS email, {_first('segment', _RECENT)} AS segment,
  list({{'city': city, 'nation_id': nation_id, 'id': client_id}} ORDER BY CAST(city IS NOT NULL AS INT) + CAST(nation_id IS NOT NULL AS INT) DESC, {_TRUSTED}, city DESC NULLS LAST, nation_id DESC NULLS LAST)[1] AS address FROM d GROUP BY cluster_id),
b AS (SELECT d.cluster_id, {_first('balance', 'coalesce(segment = chosen, false) DESC, ' + _RECENT)} AS balance FROM d JOIN (SELECT cluster_id, segment.v AS chosen FROM f) g ON d.cluster_id IS NOT DISTINCT FROM g.cluster_id GROUP BY d.cluster_id)
SELECT f.cluster_id, n_records, n_stale, name.v AS name, email.v AS email, segment.v AS segment, address.city AS city, address.nation_id AS nation_id, CAST(floor(100 * balance.v + 0.5::DOUBLE) AS BIGINT) AS balance_cents,
  name.id AS name_from, email.id AS email_from, segment.id AS segment_from, balance.id AS balance_from, CASE WHEN address.city IS NOT NULL OR address.nation_id IS NOT NULL THEN address.id END AS address_from
FROM f JOIN b ON f.cluster_id IS NOT DISTINCT FROM b.cluster_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op4_secrets": OP4_SQL, "op5_licenses": OP5_SQL, "op11_merkle": OP11_SQL, "op12_topk": OP12_SQL, "op13_golden": OP13_SQL}
