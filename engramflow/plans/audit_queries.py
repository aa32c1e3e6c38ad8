"""Records and audits: conversations as sources of records, their compact views quoted as evidence, embeddings as cues of contextual edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import access as Access
from ..operators import audits as A
from ..operators import records as R
from ..operators import upsert as U
from ..operators.numbering import number
from ..sources import dialogue as D
from .bindings import table
from .registry import query


def sources(spark, sf):
    """One source a conversation, a record a turn: assistants speak English with a gloss before it, others another language with a gloss after it."""
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    said = F.coalesce("text", F.lit(""))
    own = F.when(F.col("role") == "assistant", text("zh-TW: gloss\nen: ", said)).otherwise(text("th: ", said, "\nunknown: gloss"))
    record = text("[record: ", F.col("turn").cast("string"), "]\n[speaker_raw: ", F.col("role"), "]\n[time: none]\n", own)
    rows = table(spark, sf, "conversations").select("conv_id", F.struct("turn", record.alias("record")).alias("r"))
    return rows.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["record"]), "\n\n").alias("text"))


_TURNS = r"""t AS (SELECT conv_id AS id, turn, role, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations),
    views AS (SELECT id, turn, role, '[record: ' || turn || ']' || chr(10) || '[speaker_raw: ' || role || ']' || chr(10) || CASE WHEN role = 'assistant' THEN 'en: ' ELSE 'th: ' END ||
        array_to_string([ltrim(l[1])] || list_filter(l[2:], lambda x: trim(x) <> ''), chr(10)) AS v FROM t),
    compact AS (SELECT id, chr(10) || chr(10) || string_agg(v, chr(10) || chr(10) ORDER BY turn) AS text FROM views GROUP BY id)"""


@query("record_prose", f"""WITH {_TURNS}, b AS (SELECT id, turn, role, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '') AS l FROM t)
    SELECT id, string_agg(role || ': ' || CASE WHEN role = 'assistant' THEN 'gloss' || chr(10) || array_to_string(l, chr(10)) ELSE array_to_string(l, chr(10)) || chr(10) || 'gloss' END, chr(10) || chr(10) ORDER BY turn) AS text FROM b GROUP BY id""")
def record_prose(spark, sf):
    """What the records say, with speakers and without metadata."""
    return R.prose(sources(spark, sf))


@query("record_compact", f"WITH {_TURNS} SELECT id, text FROM compact")
def record_compact(spark, sf):
    """Records with the metadata that matters and one translation."""
    return R.compact(sources(spark, sf))


@query("evidence_audit", f"""WITH {_TURNS}, n AS (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY p) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM compact) WHERE trim(line) <> ''),
    e AS (SELECT id AS source, n, line, lead(line) OVER (PARTITION BY id ORDER BY n) AS next, count(*) OVER (PARTITION BY id) AS last, row_number() OVER (PARTITION BY id ORDER BY n) % 7 AS k FROM n)
    SELECT * FROM (SELECT 'evidence' AS "check", source || '-' || n AS key, CASE WHEN k = 1 THEN 'invalid_evidence_json' WHEN k = 2 THEN 'evidence_required_but_unavailable' WHEN k = 3 THEN 'evidence_quote_span_count_mismatch'
            WHEN n + 1 > last THEN 'evidence_span_out_of_range' WHEN k = 4 OR line || chr(10) || next <> line || chr(10) || next THEN 'evidence_quote_does_not_match_span' END AS reason FROM e) WHERE reason IS NOT NULL
    UNION ALL SELECT 'participants', source || '-' || n, 'participant_not_in_evidence' FROM e WHERE k NOT IN (1, 2, 3) AND n + 1 <= last AND NOT contains(lower(line || chr(10) || next), 'assistant')""")
def evidence_audit(spark, sf):
    """An episode for each two lines of a compact view; two of seven quote wrongly or cannot be read, others have no evidence or too few quotes, and all name the assistant."""
    views = R.compact(sources(spark, sf))
    own = Window.partitionBy("id").orderBy("n")
    rows = A.numbered(views).withColumn("next", F.lead("line").over(own)).withColumn("k", F.col("n") % 7)
    quote = F.concat("line", F.lit("\n"), F.coalesce("next", F.lit("")), F.when(F.col("k") == 4, "!").otherwise(""))
    k = F.col("k")
    episodes = rows.select(
        F.concat_ws("-", "id", "n").alias("id"), F.col("id").alias("source_id"), F.when(k == 2, A.NONE).otherwise(A.BASIS).alias("basis"),
        F.when(k == 3, F.lit("[]")).otherwise(F.to_json(F.array(quote))).alias("quotes_json"),
        F.when(k == 1, F.lit('[["a", 1]]')).otherwise(F.to_json(F.array(F.array("n", F.col("n") + 1)))).alias("spans_json"),
        F.lit('["assistant", "??? / assistant"]').alias("participants_json"),
    )
    return A.evidence(episodes, sources(spark, sf)).select("check", "key", "reason").distinct()


@query("storage_audit", f"""WITH c AS (SELECT vec_id AS id, CASE label % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'need' ELSE 'other' END AS kind, label % 2 AS domain, label FROM embeddings WHERE label <> 5),
    e AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, l_orderkey % 500 AS x, l_partkey % 500 AS y, l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS target, l_linestatus AS s FROM lineitem),
    j AS (SELECT e.id, x, y, s, a.kind AS ka, b.kind AS kb, a.domain AS da, b.domain AS db, o.o_orderkey AS there FROM e LEFT JOIN c a ON a.id = x LEFT JOIN c b ON b.id = y LEFT JOIN orders o ON o.o_orderkey = target),
    f AS (SELECT id, unnest([CASE WHEN ka IS NULL THEN 'orphan_context_cue' END, CASE WHEN kb IS NULL THEN 'orphan_need_cue' END,
        CASE WHEN (ka IS NOT NULL OR kb IS NOT NULL) AND NOT coalesce(x <> y AND ((ka = 'context' AND kb = 'need') OR (ka = 'need' AND kb = 'context')), false) THEN 'invalid_cue_kind' END,
        CASE WHEN da <> db THEN 'cross_domain_edge' END, CASE WHEN there IS NULL THEN 'invalid_target' END, CASE WHEN s <> 'O' THEN 'invalid_claim_level' END]) AS reason FROM j)
    SELECT 'storage' AS "check", reason, count(*) AS n, count(DISTINCT id) AS keys FROM f WHERE reason IS NOT NULL GROUP BY reason
    UNION ALL SELECT 'cues', 'invalid_vector', count(*), count(DISTINCT id) FROM c WHERE label = 3 HAVING count(*) > 0""")
def storage_audit(spark, sf):
    """Line items as contextual edges between two embeddings (those of label 5 are missing, those of label 3 not of length one) that aim at their orders."""
    label = F.col("label")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scaled = F.transform("embedding", lambda x: x / F.when(label == 3, length / 2).otherwise(length))
    kind = F.when(label % 3 == 0, "context").when(label % 3 == 1, "need").otherwise("other")
    cues = table(spark, sf, "embeddings").where("label <> 5").select(F.col("vec_id").alias("id"), kind.alias("kind"), (label % 2).alias("domain"), F.size("embedding").alias("dimension"), scaled.alias("vector"))
    lost = F.when(F.col("l_linenumber") == 7, 1000000000).otherwise(0)
    edges = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.lit("contextual_recall").alias("mode"), (F.col("l_orderkey") % 500).alias("context_cue_id"), (F.col("l_partkey") % 500).alias("need_cue_id"),
        F.lit("episode").alias("to_type"), (F.col("l_orderkey") + lost).alias("to_id"), F.when(F.col("l_linestatus") == "O", "retrieval_only").otherwise("direct_fact").alias("claim_level"),
    ).distinct()
    nodes = table(spark, sf, "orders").select(F.lit("episode").alias("type"), F.col("o_orderkey").alias("id"))
    return A.storage(edges, cues, nodes).groupBy("check", "reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


@query("dialogue_blocks", r"""WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, turn % 5 = 3 AS bg, turn = 0 AS tr FROM conversations),
    o AS (SELECT *, role = 'system' AS preview, t <> '' AND role <> 'system' AND (role = 'assistant' OR turn % 4 = 0) AS told,
        CASE WHEN tr OR role = 'system' THEN 3 WHEN bg THEN 2 WHEN role = 'user' THEN CASE WHEN turn * 700 >= 2000 THEN 2 ELSE 1 END ELSE 0 END AS own FROM r),
    g AS (SELECT *, coalesce(sum(told::INT) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM o),
    b AS (SELECT *, max(own) OVER (PARTITION BY conv_id, run) AS boundary FROM g)
    SELECT 'c/' || conv_id || '.json' AS source_key, i AS record_index, CASE WHEN role = 'assistant' THEN 'assistant' ELSE '' END AS speaker, t AS text, CASE WHEN role = 'assistant' THEN 'line ' || turn ELSE '' END AS korean, boundary, conv_id::VARCHAR AS group_id FROM b WHERE told""")
def dialogue_blocks(spark, sf):
    """Conversations written as files of dialogue scripts and read back as blocks: assistants speak by commands, users wait and every fourth of their turns has text, system turns announce."""
    role, turn, said = F.col("role"), F.col("turn").cast("string"), F.coalesce("text", F.lit(""))
    script = F.when(role == "assistant", F.concat(F.lit("1;shown;00\n"), turn, F.lit(";assistant;00;line "), turn)).when(role == "system", "#nextepisode;soon").otherwise(F.concat(F.lit("#wait;"), (F.col("turn") * 700).cast("string")))
    text = F.when((role != "user") | (F.col("turn") % 4 == 0), said)
    record = F.struct("turn", script.alias("ScriptKr"), text.alias("TextEn"), (F.col("turn") == 0).alias("Transition"), F.when(F.col("turn") % 5 == 3, "hall").alias("BGName"))
    rows = table(spark, sf, "conversations").select("conv_id", record.alias("r"))
    files = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("content"))
    content = F.to_json(F.struct(F.col("conv_id").alias("GroupId"), "content")).cast("binary")
    found = D.blocks(D.dialogue_records(files.select(F.concat(F.lit("c/"), F.col("conv_id").cast("string"), F.lit(".json")).alias("source_key"), content.alias("content"))))
    return found.select("source_key", "record_index", "speaker", F.col("languages")["en"].alias("text"), "korean", "boundary", "group_id")


def episodes(spark, sf):
    """Turns as episodes: the source is the conversation, its key the role, the run the parity of the turn."""
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("source_key"), (F.col("conv_id") % 10).alias("segment_index"), F.col("conv_id").alias("source_id"), (F.col("turn") % 2).alias("extraction_run_id"))


@query("episodes_by_key", """SELECT id, row_number() OVER (ORDER BY conv_id % 10, id) AS place FROM (SELECT *, conv_id * 1000 + turn AS id FROM conversations WHERE role = 'assistant' AND turn % 2 = 1)""")
def episodes_by_key(spark, sf):
    """The episodes of one key and run in their order."""
    found = Access.by_key(episodes(spark, sf), "assistant", 1)
    return number(found, ["segment_index", "id"], "place").select("id", "place")


@query("episodes_of_sources", "SELECT conv_id AS source_id, conv_id * 1000 + turn AS id FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels)")
def episodes_of_sources(spark, sf):
    """Ids of the episodes of the sources that have a label."""
    return Access.ids_of_sources(episodes(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").alias("source_id")))


@query("sources_without_paragraphs", "SELECT conv_id AS id, min(role) AS source_key, min(conv_id % 10) AS segment_index FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) AND conv_id IN (SELECT doc_id FROM documents) GROUP BY conv_id")
def sources_without_paragraphs(spark, sf):
    """Documents with episodes and without paragraphs (labels stand for these)."""
    sources = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return Access.sources_without_paragraphs(sources, episodes(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").alias("source_id")))


@query("alias_snapshot", "SELECT n_nationkey AS id, s_name AS normalized_alias FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def alias_snapshot(spark, sf):
    """Nations as concepts with rich suppliers' names as aliases."""
    concepts = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    aliases = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").cast("long").alias("concept_id"), F.col("s_suppkey").alias("alias_id"), F.col("s_name").alias("normalized_alias"))
    return Access.alias_snapshot(concepts, aliases).select(F.col("id").cast("int").alias("id"), "normalized_alias")


@query("contextual_edges", "SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def contextual_edges(spark, sf):
    """Returned items are contextual edges; those in the state F."""
    mode = F.when(F.col("l_returnflag") == "R", "contextual_recall").otherwise("semantic")
    edges = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), mode.alias("association_mode"), F.col("l_linestatus").alias("lifecycle_state")).distinct()
    return Access.contextual(edges, "F").select("id")


@query("cue_prototypes", "SELECT vec_id AS id FROM embeddings WHERE label % 3 = 1 AND label % 2 = 0")
def cue_prototypes(spark, sf):
    cues = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).cast("string").alias("domain"), F.when(F.col("label") % 2 == 0, "need").otherwise("context").alias("cue_kind"))
    return Access.prototypes(cues, "1", "Need").select("id")


@query("paragraph_texts", r"""SELECT conv_id, turn, trim('speaker: ' || role || chr(10) || chr(10) || array_to_string(list_transform(string_split(regexp_replace(trim(coalesce(text, ''), E' \n'), '\n[ \n]*\n', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x)), chr(10)), E' \n') AS text FROM conversations""")
def paragraph_texts(spark, sf):
    """Turns wrapped in everything that an embedding leaves out."""
    text = F.concat(F.lit("[speaker_alias_legend]\nAnn = A\n[record: 1]\n[speaker_raw: "), "role", F.lit("]\n[script_raw: 1;x\n[record: 9\n]\n\n\n"), F.coalesce("text", F.lit("")), F.lit("\n[source_key: k]\n[meta: x]"))
    return table(spark, sf, "conversations").select("conv_id", "turn", Access.paragraph_texts(text).alias("text"))


@query("vector_codec", """SELECT vec_id, len(embedding) AS dimension, 4 * len(embedding) AS bytes, true AS same FROM embeddings""")
def vector_codec(spark, sf):
    """Embeddings as blobs of unit length and back: whether every component is that of the unit vector in 32 bits."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    coded = table(spark, sf, "embeddings").select("vec_id", "embedding", length.alias("length"), Access.encode_vectors(F.col("embedding")).alias("blob"))
    pairs = F.arrays_zip(Access.decode_vectors(F.col("blob"), 64).alias("a"), F.col("embedding").alias("b"))
    same = F.forall(pairs, lambda p: F.abs(p["a"].cast("double") - p["b"].cast("double") / F.col("length")) < 1e-6)
    return coded.select("vec_id", F.size("embedding").cast("long").alias("dimension"), F.octet_length("blob").cast("long").alias("bytes"), same.alias("same"))


@query("fact_ids", """SELECT doc_id, 'f_' || sha256('{"claim":"' || lang || ' / ' || source || '","end":' || (n_chars + 1) || ',"episode_id":' || doc_id * 2 || ',"source_id":' || doc_id || ',"source_sha256":"' || sha256(source) || '","start":' || doc_id % 7 || '}') AS fact_id FROM documents""")
def fact_ids(spark, sf):
    """What each document claims about its language and source, as a fact with a stable id."""
    docs = table(spark, sf, "documents")
    claim = F.concat(F.lit(" "), "lang", F.lit(" / "), "source", F.lit("\n"))
    return docs.select("doc_id", Access.fact_id(F.col("doc_id"), F.col("doc_id") * 2, F.sha2("source", 256), F.col("doc_id") % 7, F.col("n_chars") + 1, claim).alias("fact_id"))


@query("used_edges", """SELECT o_orderkey AS id, CASE WHEN l.k IS NOT NULL THEN 4 ELSE 3 END AS use_count, l.k IS NOT NULL AS used_now FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45) l ON l.k = o_orderkey""")
def used_edges(spark, sf):
    """Orders as edges that were used three times; those with a large item are used once more, however many such items they have."""
    edges = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(3).alias("use_count"), F.lit(None).cast("timestamp").alias("last_used"))
    used = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return U.mark_used(edges, used, F.current_timestamp()).select("id", "use_count", F.col("last_used").isNotNull().alias("used_now"))
