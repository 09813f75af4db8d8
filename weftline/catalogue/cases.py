"""Record linkage, extraction, ledger, question answering and reports over the case tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import timewords as TW
from weftline.operators import ask as A
from weftline.operators import extract as E
from weftline.operators import ledger as L
from weftline.operators import report as P
from weftline.operators import resolution as ER
from weftline.sources import files as FL
from weftline.sources.tables import table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "source", "created_at", "investigation_id")


def resolution_found(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "entities").select("entity_id", "type", "name", "phone", "district", F.col("linked_investigation_id").alias("case_id"))
    return ER.candidates(e).select("a", "b", F.round("name_score", 6).alias("name_score"), F.round("score", 6).alias("score"), "method", "factors")


def resolution_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that equal each other in all compared attributes, where they lie in several cases."""
    e = table(spark, sf, "entities").select("entity_id", "type", "name", "phone", "district", F.col("linked_investigation_id").alias("case_id"))
    m = ER.class_members(e)
    across = m.groupBy("class_id").agg(F.count_distinct("case_id").alias("n")).where("n > 1")
    return m.join(across.select("class_id"), "class_id", "left_semi")


def resolution_review(spark: SparkSession, sf: str) -> DataFrame:
    """Stored pairs with their status, what became of them and whether they lie in different cases."""
    r = table(spark, sf, "resolution_candidates").where("mention_a is not null and mention_b is not null and mention_a <> mention_b")
    ent = table(spark, sf, "entities").where("linked_investigation_id is not null").groupBy("entity_id").agg(F.min("linked_investigation_id").alias("c"))
    c = ER.connections(r.select(F.least("mention_a", "mention_b").alias("a"), F.greatest("mention_a", "mention_b").alias("b"), "status").distinct())
    j = c.join(ent.select(F.col("entity_id").alias("a"), F.col("c").alias("ca")), "a", "left").join(ent.select(F.col("entity_id").alias("b"), F.col("c").alias("cb")), "b", "left")
    return j.select("a", "b", "status", "kind", F.coalesce(F.col("ca") != F.col("cb"), F.lit(False)).alias("across"))


def resolution_connections(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "resolution_candidates").select(F.col("mention_a").alias("a"), F.col("mention_b").alias("b"), "status")
    return ER.connections(r).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("a").alias("n_a"))


def levenshtein_names(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "resolution_candidates").where("mention_a_name is not null and mention_b_name is not null")
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")  # noqa: E731  the SQL engine counts bytes
    return r.select("id", "mention_a_name", "mention_b_name").distinct().select("id", F.round(T.edit_ratio(plain("mention_a_name"), plain("mention_b_name")), 6).alias("ratio"))


def jaro_winkler_names(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "resolution_candidates").select("id", "mention_a_name", "mention_b_name").distinct()
    return r.select("id", T.jaro_winkler("mention_a_name", "mention_b_name").alias("jw"), T.person_name_similarity("mention_a_name", "mention_b_name").alias("name_score"))


def normalise_phones(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "entities").where("upper(type) = 'PHONE'")
    return e.select("entity_id", "name").distinct().select("entity_id", T.phone(F.col("name")).alias("phone"))


def normalise_plates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "entities").where("upper(type) = 'VEHICLE'").select(T.plate(F.col("name")).alias("plate"))
    return e.groupBy("plate").agg(F.count("*").alias("n"))


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    x = E.lines(_docs(spark, sf))
    return x.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("line_no").alias("last_no"))


def csv_segments(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "investigations").select("id", "classification", "priority", "district").distinct()
    return i.select("id", E.csv_segments(i, ["classification", "priority", "district"]).alias("segment"))


def json_segments(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "props")
    return E.json_segments(ev, "props").select("event_id", "segment")


def evidence_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Files of all kinds made of the events, read by extension: segments, and failures of their own."""
    kind = F.element_at(F.array(*map(F.lit, (".json", ".csv", ".txt", ".pdf", ".bin"))), (F.col("event_id") % 5 + 1).cast("int"))
    csv = F.concat(F.lit("event,value\n"), F.col("event_id").cast("string"), F.lit(","), F.col("event_type"), F.lit("\n\nodd row\n"))
    content = F.when(kind == ".json", F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "items": [{"type": "'), F.col("event_type"), F.lit('", "none": null}, 7]}'))).when(kind == ".csv", csv).otherwise(F.concat(F.lit("\nline "), "event_type", F.lit("\n")))
    made = table(spark, sf, "events").select(F.concat(F.col("event_id").cast("string"), kind).alias("path"), F.encode(content, "UTF-8").alias("content"))
    return FL.segments(made).select("path", "file_type", "status", "segment_no", "text")


def extract_entities(spark: SparkSession, sf: str) -> DataFrame:
    return E.entities(_docs(spark, sf))


def extract_relations(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return E.relations(d, E.entities(d))


def language_detect(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select(F.when(F.col("text").rlike("[\\u0900-\\u097F]"), "mr").otherwise("en").alias("detected"))
    return d.groupBy("detected").agg(F.count("*").alias("n"))


def ledger_build(spark: SparkSession, sf: str) -> DataFrame:
    return L.build(L.records(_docs(spark, sf), "source")).select("chain", "doc_id", "block_index", "prev_hash", "block_hash")


def _tampered(spark: SparkSession, sf: str) -> DataFrame:
    b = L.build(L.records(_docs(spark, sf), "source"))
    flip = lambda c, m: F.when(F.col("doc_id") % m == 0, F.sha2(F.col(c), 256)).otherwise(F.col(c)).alias(c)
    return b.select("chain", "doc_id", "block_index", "body", flip("content_hash", 29), flip("prev_hash", 31), flip("block_hash", 37))


def ledger_verify(spark: SparkSession, sf: str) -> DataFrame:
    return L.verify(_tampered(spark, sf))


def evidence_versions(spark: SparkSession, sf: str) -> DataFrame:
    return L.versions(_docs(spark, sf), "source")


def integrity_status(spark: SparkSession, sf: str) -> DataFrame:
    t = _tampered(spark, sf)
    return L.integrity(_docs(spark, sf), t.where("doc_id % 41 <> 0"), L.verify(t).where("reason <> 'VALID'"))


def intent_router(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("text is not null").select("doc_id", A.intent(F.col("text")).alias("intent"))


def _questions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = _docs(spark, sf).select("doc_id", F.col("investigation_id").alias("case_id"), "text")
    e = table(spark, sf, "entities").where("linked_investigation_id is not null").select(F.col("linked_investigation_id").alias("case_id"), "name", F.col("phone").alias("value"))
    return q, e


def mention_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return A.mentions(*_questions(spark, sf))


def prompt_sanitiser(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.sha2(A.sanitised(F.col("text")), 256).alias("said"))


def context_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """What an answer about each case may draw on: its newest entities and documents, best pairs, first events, places."""
    ent = table(spark, sf, "entities").groupBy("entity_id").agg(F.min("linked_investigation_id").alias("case_id"), F.max("created_at").alias("t")).select("case_id", F.col("entity_id").alias("item"), "t")
    pairs = table(spark, sf, "resolution_candidates").select(F.col("investigation_id").alias("case_id"), F.col("id").alias("item"), "score").distinct()
    ev = table(spark, sf, "timeline_events").select("case_id", F.col("id").alias("item"), "start_time_utc").distinct()
    places = table(spark, sf, "timeline_events").where("location_entity_id is not null").select("case_id", F.col("location_entity_id").alias("item")).distinct()
    docs = _docs(spark, sf).select(F.col("investigation_id").alias("case_id"), F.col("doc_id").alias("item"), "created_at")
    return A.context({
        "entities": (ent, [F.desc_nulls_last("t"), F.asc("item")], 10),
        "pairs": (pairs, [F.desc_nulls_last("score"), F.asc("item")], 15),
        "events": (ev, [F.asc_nulls_first("start_time_utc"), F.asc("item")], 15),
        "places": (places, [F.asc("item")], 10),
        "documents": (docs, [F.desc_nulls_last("created_at"), F.asc("item")], 6),
    })


def answer_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Each case's reviewed pairs as an answer: pairs are claims, facts if reviewed, cited by entities and reviewers."""
    r = table(spark, sf, "resolution_candidates").where("investigation_id is not null").select("id", "investigation_id", "mention_a", "mention_b", "reviewed_by", "score").distinct()
    claims = r.groupBy("id").agg(F.min("investigation_id").alias("answer_id"), F.when(F.count("reviewed_by") > 0, "FACT").otherwise("MODEL").alias("kind")).withColumnRenamed("id", "claim_id")
    cited = r.where("reviewed_by is not null").select(F.col("id").alias("claim_id"), F.explode(F.array("mention_a", "mention_b", "reviewed_by")).alias("cited"))
    known = table(spark, sf, "entities").where("deleted_at is null").select(F.col("entity_id").alias("id")).unionByName(table(spark, sf, "users").where("deleted_at is null").select("id"))
    done = A.checked_claims(claims, cited, known)
    g = done.groupBy("answer_id").agg(
        F.count("*").alias("n_claims"), F.count_if(~F.col("supported")).alias("n_unsupported"), F.count_if(F.col("kind") == "MODEL").alias("n_models"),
        F.count_if((F.col("kind") == "FACT") & (F.col("n_valid") >= 3)).alias("n_evidence"), F.count_if((F.col("kind") == "FACT") & (F.col("n_valid") == 2)).alias("n_relations"),
    )
    level = A.answer_confidence(*[F.col(c) for c in ("n_claims", "n_unsupported", "n_models", "n_evidence", "n_relations")])
    return g.withColumn("x", level).select("answer_id", "n_claims", "n_unsupported", "n_models", "n_evidence", "n_relations", "x.confidence", "x.score")


def time_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """Request texts read without zones; the reference date where it is written year first, else none."""
    r = table(spark, sf, "temporal_requests").select("request_id", "text", "reference_date").distinct()
    ref = F.try_to_timestamp(F.regexp_extract("reference_date", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))
    return r.select("request_id", TW.time_expression(F.col("text"), ref).alias("x")).select("request_id", "x.*")


def citation_check(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "resolution_candidates").select(F.concat_ws("~", F.least("mention_a", "mention_b"), F.greatest("mention_a", "mention_b")).alias("fact_id"), F.col("reviewed_by").alias("cited"))
    known = table(spark, sf, "users").where("deleted_at is null").select("id")
    return A.checked_citations(r.select("fact_id"), r.where("cited is not null"), known)


def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    ent = table(spark, sf, "entities").dropDuplicates(["entity_id"])
    ev = table(spark, sf, "timeline_events").dropDuplicates(["id"])
    docs = table(spark, sf, "documents")
    nodes = table(spark, sf, "graph_nodes").dropDuplicates(["id"])
    return P.dashboard([
        P.tally(ent, "linked_investigation_id", {"entities": F.count("*"), "entities_critical": F.count_if(F.col("risk") == "CRITICAL"), "entities_deleted": F.count("deleted_at")}),
        P.tally(ev, "case_id", {"events": F.count("*"), "events_rejected": F.count_if(F.col("verification_status") == "REJECTED"), "events_without_time": F.count_if(F.col("start_time_utc").isNull()), "events_low_confidence": F.count_if(F.col("confidence") < 0.7), "places": F.count_distinct("location_entity_id")}),
        P.tally(docs, "investigation_id", {"documents": F.count("*"), "documents_empty": F.count_if(F.col("n_chars") == 0), "sources": F.count_distinct("source")}),
        P.tally(nodes, "investigation_id", {"nodes": F.count("*"), "nodes_without_entity": F.count_if(F.trim(F.coalesce("entity_id", F.lit(""))) == "")}),
    ])


def case_report(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    inv = table(spark, sf, "investigations").groupBy("id").agg(F.max("case_number").alias("no"), F.max("title").alias("title"), F.max("status").alias("status"))
    ent = table(spark, sf, "entities").where("linked_investigation_id is not null").select(F.col("linked_investigation_id").alias("case_id"), "entity_id", "name", "type").distinct()
    doc = table(spark, sf, "documents").where("investigation_id is not null").select(F.col("investigation_id").alias("case_id"), "doc_id", "source", "n_chars", "created_at")
    by_name = F.row_number().over(W.partitionBy("case_id").orderBy("name", "entity_id", "type"))
    newest = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc_nulls_last("created_at"), "doc_id"))
    return P.sections([
        ("case", inv.select(F.col("id").alias("case_id"), F.lit(1).alias("ord"), P.csv_line(F.col("no"), F.col("title"), F.col("status")).alias("line"))),
        ("entities", ent.select("case_id", by_name.alias("ord"), P.csv_line(F.col("entity_id"), F.col("name"), F.col("type")).alias("line"))),
        ("documents", doc.select("case_id", newest.alias("ord"), P.csv_line(F.col("doc_id"), F.col("source"), F.col("n_chars")).alias("line"))),
    ])


_ALL = [resolution_found, resolution_connections, levenshtein_names, jaro_winkler_names, normalise_phones, normalise_plates, text_lines, csv_segments, json_segments,
        extract_entities, extract_relations, language_detect, ledger_build, ledger_verify, evidence_versions, integrity_status, intent_router, mention_extraction,
        prompt_sanitiser, citation_check, dashboard, case_report, resolution_classes, resolution_review, evidence_segments, context_bundle, answer_levels, time_expressions]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The extraction's patterns, written out once more for the SQL side.
_SQL_PASSES = (
    ("PHONE", r"(?:\+91[\s\-]?)?(?:[6-9]\d{4}[\s\-]?\d{5}|[6-9]\d{9})\b", 0, 0.98),
    ("VEHICLE", r"(?i)\b(?:MH|DL|GJ|KA|TN|HR|UP|MP|AP|TS|WB|KL|RJ|PB|BR|OD|GA)[-\s]?\d{1,2}[-\s]?[A-Z]{1,3}[-\s]?\d{3,4}\b", 0, 0.95),
    ("ACCOUNT", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0, 0.96),
    ("ACCOUNT", r"(?i)\b(?:A/C|Account|Acc|AC|IBAN|Mule\s+Account)[\s:#\-]+([A-Z0-9]{8,20})\b", 1, 0.92),
    ("ACCOUNT", r"(?i)\b[a-zA-Z0-9.\-_]{3,30}@(?:okhdfcbank|okaxis|oksbi|okicici|paytm|apl|ybl|axl|ibl)\b", 0, 0.97),
    ("CASE", r"(?i)\b(?:FIR|CASE|CRIME|MHP|MH)-[A-Z0-9\-/]{4,25}\b", 0, 0.95),
    ("DEVICE", r"(?i)\b(?:IMEI|MAC|Device|SIM)[\s:#\-]+([A-F0-9:]{12,17}|\d{14,16})\b", 1, 0.94),
    ("PERSON", r"\b(?:Shri|Smt|Mr|Mrs|Ms|Inspector|Insp|Sub-Insp|PSI|API|ACP|DCP|Subject|Suspect|Accused|Witness|Driver|Operator|Associate)\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b", 1, 0.95),
    ("PERSON", r"\b([A-Z][a-z]{2,15}\s+[A-Z][a-z]{2,15}(?:\s+[A-Z][a-z]{2,15})?)\b", 1, 0.88),
)
_SQL_PLACES = "pune,pune central,mumbai,mumbai port,mumbai dock area,nashik,nashik road,thane,navi mumbai,nagpur,solapur,aurangabad,chhatrapati sambhajinagar,bandra,kurla,bandra kurla complex,andheri,dadar,shivajinagar,colaba,byculla,worli,dharavi,panvel,vashi,kalyan,dombivli,borivali,docks".split(",")
_SQL_ORG = "syndicate,pvt ltd,ltd,limited,bank,enterprises,logistics,traders,trust,hospital,customs,port trust,finance,agency,corporation".split(",")
_SQL_NO_NAMES = "investigation report,crime branch,police station,charge sheet,forensic lab,call detail,pune central,nashik road,dock area,mumbai port,bandra kurla,pune city,first information,cdr records,central bank,state bank,cargo transit,air cargo,customs clearance".split(",")


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_lit, words)) + "]"


def _entities_sql() -> str:
    one = "trim(regexp_replace(v, '\\s+', ' ', 'g'))"
    title = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    kept = "regexp_replace(v, '[^0-9+]', '', 'g')"
    d0 = f"CASE WHEN {kept} LIKE '+%' THEN substr({kept}, 2) ELSE {kept} END"
    d = f"CASE WHEN length(ltrim({d0}, '0')) >= 10 THEN ltrim({d0}, '0') WHEN length({d0}) > 10 THEN right({d0}, 10) ELSE {d0} END"
    norm = {
        "PHONE": f"CASE WHEN length({d}) = 12 AND {d} LIKE '91%' THEN '+' || {d} WHEN length({d}) = 10 THEN '+91' || {d} WHEN {kept} LIKE '+%' THEN {kept} ELSE '+' || {d} END",
        "VEHICLE": r"upper(regexp_replace(v, '[\s\-.]', '', 'g'))", "ACCOUNT": r"upper(regexp_replace(v, '[\s\-/]', '', 'g'))", "DEVICE": r"upper(regexp_replace(v, '[\s\-/]', '', 'g'))",
        "PERSON": title(rf"regexp_replace({one}, '(?i)^(?:Shri|Smt|Mr|Mrs|Ms|Insp|Inspector|Sub-Insp|PSI|API|ACP|DCP|Dr)\.?\s+', '')"), "LOCATION": title(one), "ORGANIZATION": f"upper({one})",
    }
    parts = []
    for k, (kind, p, g, conf) in enumerate(_SQL_PASSES):
        no = _SQL_PLACES if kind == "PERSON" and k < 8 else _SQL_PLACES + _SQL_NO_NAMES if kind == "PERSON" else []
        cond = f"WHERE NOT list_contains({_list(no)}, lower(trim(v)))" if no else ""
        cond += f" AND NOT regexp_matches(lower(v), '{'|'.join(_SQL_ORG)}')" if k == 8 else ""
        parts.append(f"SELECT doc_id, '{kind}' AS type, {norm.get(kind, one)} AS value, v, {conf}::DOUBLE AS confidence, {k} AS pass, nth FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_lit(p)}, {g})) AS v, generate_subscripts(regexp_extract_all(text, {_lit(p)}, {g}), 1) AS nth FROM documents WHERE text IS NOT NULL) {cond}")
    parts.append(f"SELECT doc_id, 'LOCATION', {norm['LOCATION']}, v, 0.92::DOUBLE, 9, nth FROM (SELECT doc_id, p.nth, regexp_extract(text, '(?i)\\b' || p.w || '\\b', 0) AS v FROM documents, (SELECT unnest({_list(_SQL_PLACES)}) AS w, unnest(range(0, 29)) AS nth) p WHERE contains(lower(text), p.w)) WHERE v <> ''")
    parts.append(f"""SELECT doc_id, 'ORGANIZATION', {norm['ORGANIZATION']}, v, 0.88::DOUBLE, 10, nth FROM (SELECT doc_id, l.nth * 100 + p.nth AS nth, regexp_extract(line, '(?i)\\b([A-Z0-9][A-Za-z0-9\\s&]{{2,30}}\\b' || p.w || '\\b[A-Za-z0-9\\s]{{0,15}})', 0) AS v
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents) l, (SELECT unnest({_list(_SQL_ORG)}) AS w, unnest(range(0, 15)) AS nth) p WHERE contains(lower(line), p.w))""")
    return f"ents AS (SELECT doc_id, type, value, arg_min(trim(v), pass::BIGINT * 1000000000 + nth) AS raw, arg_min(confidence, pass) AS confidence FROM ({' UNION ALL '.join(parts)}) WHERE length(trim(v)) >= 2 GROUP BY doc_id, type, value)"


def _relations_sql() -> str:
    said = {
        "CALLED": (r"called|phoned|dialed|spoke\s+with|contacted|communicated\s+with", 0.94, "PERSON,PHONE", "PERSON,PHONE"),
        "USED": (r"used|drove|operated|travelled\s+in|seen\s+driving", 0.92, "PERSON,ORGANIZATION", "VEHICLE,PHONE,DEVICE,ACCOUNT"),
        "OWNED": (r"owns|owned|registered\s+to|proprietor\s+of|vehicle\s+owner", 0.95, "PERSON,ORGANIZATION", "VEHICLE,ACCOUNT,ORGANIZATION,DEVICE"),
        "VISITED": (r"visited|travelled\s+to|spotted\s+at|stayed\s+at|arrived\s+at", 0.90, "PERSON,VEHICLE", "LOCATION"),
        "LOCATED_AT": (r"located\s+at|stationed\s+at|based\s+in|headquartered\s+in", 0.91, "PERSON,ORGANIZATION,DEVICE,VEHICLE", "LOCATION"),
        "WORKED_FOR": (r"worked\s+for|employed\s+by|operative\s+for|subordinate\s+of", 0.93, "PERSON", "ORGANIZATION"),
        "ASSOCIATED_WITH": (r"associated\s+with|cohort\s+of|accomplice\s+of|partner\s+in", 0.88, "PERSON", "PERSON"),
        "INVOLVED_IN": (r"involved\s+in|implicated\s+in|suspect\s+in|named\s+in", 0.92, "PERSON,ORGANIZATION,VEHICLE", "CASE"),
        "TRANSFERRED_TO": (r"transferred\s+to|sent\s+funds\s+to|paid|wired\s+to|remitted\s+to", 0.95, "PERSON,ACCOUNT", "PERSON,ACCOUNT"),
        "MET": (r"met\s+with|rendezvous\s+with|conferred\s+with|held\s+meeting\s+with", 0.91, "PERSON", "PERSON"),
    }
    rows = ", ".join(f"('{r}', {_lit(chr(92) + 'b(?:' + v + ')' + chr(92) + 'b')}, {c}::DOUBLE, {_list(a.split(','))}, {_list(b.split(','))})" for r, (v, c, a, b) in said.items())
    return f"""WITH {_entities_sql()}, rule(relation, verbs, confidence, src_types, dst_types) AS (VALUES {rows}),
    sen AS (SELECT doc_id, no, lower(trim(s)) AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\\n;]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.\\n;]+'), 1) AS no FROM documents) WHERE trim(s) <> ''),
    said AS (SELECT doc_id, no, s, rule.* FROM sen JOIN rule ON regexp_matches(s, verbs)),
    here AS (SELECT a.*, e.type, e.value FROM said a JOIN ents e USING (doc_id) WHERE contains(a.s, lower(e.raw)) OR contains(a.s, lower(e.value)))
    SELECT DISTINCT x.doc_id, x.value AS src, x.relation, y.value AS dst, x.confidence FROM here x JOIN here y ON x.doc_id = y.doc_id AND x.no = y.no AND x.relation = y.relation
    WHERE (x.value <> y.value OR x.type <> y.type) AND list_contains(x.src_types, x.type) AND list_contains(x.dst_types, y.type)"""


_SQL_INTENTS = (
    ("SHORTEST_PATH", r"path between|shortest path|how (is|are).*(connected|linked)|connection between|how do.*connect", "कसा जोडलेला|कसे जोडलेले|मार्ग|जोडणारा दुवा|संबंध काय आहे"),
    ("CROSS_CASE", r"cross[\s-]cases?|other cases?|another case|shared between|in another investigation|across.*cases?", "इतर गुन्हे|दुसऱ्या प्रकरणात|सामायिक|आंतर-प्रकरण"),
    ("INTEGRITY", r"integrity|tamper|verif(ied|ication|y)|validat(ed|ion)|ledger|blockchain|hash mismatch|sha-256|chain status", "सत्यता|छेडछाड|पडताळणी|लेजर|हॅश|ब्लॉकचेन"),
    ("ALERT", r"alerts?|anomal(y|ies)|suspicious signal|priority alert", "अलर्ट|सूचना|संशयास्पद|धोका"),
    ("MODEL_SIGNAL", r"model signal|gat prediction|predicted|predictions?|ai prediction|potential link", "मॉडेल|संकेत|अंदाज|संभाव्य दुवा"),
    ("TIMELINE", r"timeline|what happened|sequence|chronology|before|after|when did|events?", "वेळरेषा|घटना|क्रम|कधी घडले|तारीख"),
    ("LOCATION", r"where was|where did|locations?|geospatial|visited|travel|overlap|places?", "कुठे|ठिकाण|पत्ता|पत्ते|स्थान"),
    ("EVIDENCE", r"what evidence|which document|proof|source for|supporting evidence|which file|mention(ed)?", "पुरावा|कागदपत्र|दस्तऐवज|पुरावे"),
    ("GRAPH_ANALYTICS", r"centrality|most connected|key entities|broker|bridge node|pagerank|structurally", "प्रमुख घटक|महत्त्वाचे घटक|मध्यवर्ती|सर्वाधिक जोडलेले"),
    ("ENTITY_RELATIONSHIPS", r"who is connected|associates of|contacts of|connected with|relationships of|phones of|vehicles of|associated with|who communicates", "प्रमुख संबंध|कोण जोडलेले आहे|संबंध कोणते|संबंधितांची नावे|संबंध"),
    ("ENTITY_LOOKUP", r"who is|what is|tell me about|details of|profile of|information on", "माहिती सांगा|तपशील|कोण आहे|काय आहे"),
)


def _time_sql() -> str:
    months = "map {'january': 1, 'jan': 1, 'february': 2, 'feb': 2, 'march': 3, 'mar': 3, 'april': 4, 'apr': 4, 'may': 5, 'june': 6, 'jun': 6, 'july': 7, 'jul': 7, 'august': 8, 'aug': 8, 'september': 9, 'sep': 9, 'sept': 9, 'october': 10, 'oct': 10, 'november': 11, 'nov': 11, 'december': 12, 'dec': 12}"
    iso, tr = r"(?i)\b(\d{4})-(\d{2})-(\d{2})[T\s](\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", r"(?i)\b(?:between\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(?:to|–|-|and)\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\b"
    dt, dmy = r"(?i)\b(\d{1,2})[/\-\s]([A-Za-z]+|\d{1,2})[/\-\s](\d{4})\s+(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?\b", r"(?i)\b(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\b"
    num, ymd, dr = r"\b(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})\b", r"\b(\d{4})-(\d{2})-(\d{2})\b", r"(?i)\b(?:between\s+)?(\d{1,2})\s*(?:and|to|–|-)\s*(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\b"
    my, dp = r"\b([A-Za-z]+|\d{1,2})[/\s](\d{4})\b", r"(?i)\b(morning|afternoon|evening|night|dawn|dusk)\s+of\s+(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\b"
    later = r"(?i)\b(?:(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+days?\s+(?:later|after|following))\b"
    g = lambda p, k: f"regexp_extract(t, {_lit(p)}, {k})"
    m = lambda c: f"{months}[lower({c})]"
    mn = lambda c: f"coalesce({months}[lower({c})], try_cast({c} AS INT))"
    at = lambda y, mo, d, h, mi, s: f"try_cast({y}::VARCHAR || '-' || lpad(({mo})::VARCHAR, 2, '0') || '-' || lpad({d}::VARCHAR, 2, '0') || ' ' || lpad({h}::VARCHAR, 2, '0') || ':' || lpad({mi}::VARCHAR, 2, '0') || ':' || lpad({s}::VARCHAR, 2, '0') AS TIMESTAMP)"
    sec = lambda p, k: f"CASE WHEN {g(p, k)} <> '' THEN {g(p, k)} ELSE '0' END"
    clock = lambda p, y, mo, d, h: at(y, mo, d, g(p, h), g(p, h + 1), sec(p, h + 2))
    part = lambda i: f"CASE lower({g(dp, 1)}) " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in {"morning": (6, 12), "afternoon": (12, 18), "evening": (18, 22), "night": (22, 23), "dawn": (4, 7), "dusk": (17, 20)}.items()) + " END"
    n = f"coalesce(map {{'one': 1, 'two': 2, 'three': 3, 'four': 4, 'five': 5, 'six': 6, 'seven': 7, 'eight': 8, 'nine': 9, 'ten': 10}}[lower({g(later, 1)})], try_cast({g(later, 1)} AS INT))"
    rules = [
        (clock(iso, g(iso, 1), g(iso, 2), g(iso, 3), 4), None, f"CASE WHEN {g(iso, 6)} <> '' THEN 'EXACT' ELSE 'MINUTE' END", False, 0.99),
        (at(g(dp, 4), m(g(dp, 3)), g(dp, 2), part(0), 0, 0), at(g(dp, 4), m(g(dp, 3)), g(dp, 2), part(1), 0, 0), "'HOUR'", True, 0.85),
        (at(g(dr, 4), m(g(dr, 3)), g(dr, 1), 0, 0, 0), at(g(dr, 4), m(g(dr, 3)), g(dr, 2), 23, 59, 59), "'DAY'", False, 0.90),
        (clock(dt, g(dt, 3), mn(g(dt, 2)), g(dt, 1), 4), None, f"CASE WHEN {g(dt, 6)} <> '' THEN 'EXACT' ELSE 'MINUTE' END", False, 0.95),
        tuple(f"CASE WHEN {g(tr, 1)} <> '' THEN {at('year(ref)', 'month(ref)', 'day(ref)', g(tr, k), g(tr, k + 1), 0)} END" for k in (1, 4)) + ("'MINUTE'", False, 0.92),
        (at(g(dmy, 3), m(g(dmy, 2)), g(dmy, 1), 0, 0, 0), at(g(dmy, 3), m(g(dmy, 2)), g(dmy, 1), 23, 59, 59), "'DATE_ONLY'", False, 0.95),
        (at(g(ymd, 1), g(ymd, 2), g(ymd, 3), 0, 0, 0), at(g(ymd, 1), g(ymd, 2), g(ymd, 3), 23, 59, 59), "'DATE_ONLY'", False, 0.95),
        (at(g(num, 3), g(num, 2), g(num, 1), 0, 0, 0), at(g(num, 3), g(num, 2), g(num, 1), 23, 59, 59), "'DATE_ONLY'", False, 0.92),
        (at(g(my, 2), mn(g(my, 1)), 1, 0, 0, 0), f"{at(g(my, 2), mn(g(my, 1)), 1, 0, 0, 0)} + INTERVAL 1 MONTH - INTERVAL 1 SECOND", "'MONTH'", False, 0.88),
        (f"CASE WHEN {n} > 0 THEN date_trunc('day', ref)::TIMESTAMP + to_days({n}) END", f"CASE WHEN {n} > 0 THEN date_trunc('day', ref)::TIMESTAMP + to_days({n}) + INTERVAL 86399 SECOND END", "'DAY'", True, 0.80),
    ]
    cols = ", ".join(f"{s} AS s{k}, {e or s} AS e{k}" for k, (s, e, *_) in enumerate(rules))
    hit = lambda k: f"s{k} IS NOT NULL AND e{k} IS NOT NULL"
    pick = lambda f, vague, none: "CASE " + " ".join(f"WHEN {hit(k)} THEN {f(k)}" for k in range(len(rules))) + f" WHEN regexp_matches(t, {_lit(later)}) THEN {vague} ELSE {none} END"
    stamp = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
    return f"""WITH r AS (SELECT DISTINCT request_id, trim(text) AS t, try_cast(regexp_extract(reference_date, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS DATE) AS ref FROM temporal_requests), x AS (SELECT *, {cols} FROM r)
      SELECT request_id, {pick(lambda k: stamp(f's{k}'), 'NULL', 'NULL')} AS start_time_utc, {pick(lambda k: stamp(f'e{k}'), 'NULL', 'NULL')} AS end_time_utc, {pick(lambda k: rules[k][2], "'APPROXIMATE'", "'UNKNOWN'")} AS time_precision,
      {pick(lambda k: str(rules[k][3]).lower(), 'true', 'false')} AS is_approximate, ({pick(lambda k: str(rules[k][4]), '0.50', '0.0')})::DOUBLE AS confidence FROM x"""


_STAMP = "coalesce(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '0Z', '')"
_LEDGER = f"""rec AS (SELECT source AS chain, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, sha256(coalesce(text, '')) AS content_hash,
  doc_id || '|' || sha256(coalesce(text, '')) || '|REGISTER|' || {_STAMP} AS body FROM documents),
led(chain, i, doc_id, prev_hash, block_hash) AS (SELECT chain, i, doc_id, repeat('0', 64), sha256(i || '|' || repeat('0', 64) || '|' || body) FROM rec WHERE i = 0
  UNION ALL SELECT r.chain, r.i, r.doc_id, l.block_hash, sha256(r.i || '|' || l.block_hash || '|' || r.body) FROM led l JOIN rec r ON r.chain = l.chain AND r.i = l.i + 1)"""
_TAMPERED = """tam AS (SELECT l.chain, l.doc_id, l.i, r.body, CASE WHEN doc_id % 29 = 0 THEN sha256(r.content_hash) ELSE r.content_hash END AS content_hash,
  CASE WHEN doc_id % 31 = 0 THEN sha256(l.prev_hash) ELSE l.prev_hash END AS prev_hash, CASE WHEN doc_id % 37 = 0 THEN sha256(l.block_hash) ELSE l.block_hash END AS block_hash FROM led l JOIN rec r USING (doc_id)),
chk AS (SELECT *, CASE WHEN ph IS NULL AND prev_hash <> repeat('0', 64) THEN 'BAD_GENESIS' WHEN ph IS NOT NULL AND prev_hash <> ph THEN 'BROKEN_LINK'
  WHEN sha256(i || '|' || prev_hash || '|' || body) <> block_hash THEN 'HASH_MISMATCH' END AS reason FROM (SELECT *, lag(block_hash) OVER (PARTITION BY chain ORDER BY i) AS ph FROM tam)),
ver AS (SELECT chain, count(*) AS n_blocks, min(i) FILTER (reason IS NOT NULL)::INT AS first_bad, coalesce(arg_min(reason, i) FILTER (reason IS NOT NULL), 'VALID') AS reason FROM chk GROUP BY chain)"""


def _cell(c: str) -> str:
    return f"""'"' || replace(coalesce({c}::VARCHAR, ''), '"', '""') || '"'"""


def oracle_sql() -> dict[str, str]:
    intents = " ".join(f"WHEN regexp_matches(q, {_lit(chr(92) + 'b(' + p + ')' + chr(92) + 'b')}) OR regexp_matches(q, '{m}') THEN '{n}'" for n, p, m in _SQL_INTENTS)
    return {
        "resolution_found": r"""WITH c AS (SELECT type, name, phone, district, value, min(entity_id) AS id, list_sort(list(DISTINCT case_id) FILTER (case_id IS NOT NULL)) AS cases FROM (
               SELECT upper(type) AS type, lower(trim(regexp_replace(name, '[^\p{L}\p{Nd}]+', ' ', 'g'))) AS name, CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN regexp_replace(phone, '[^0-9]', '', 'g') END AS phone,
               nullif(lower(trim(district)), '') AS district, CASE WHEN upper(type) IN ('PHONE', 'VEHICLE', 'ACCOUNT', 'EMAIL') THEN lower(trim(name)) END AS value,
               linked_investigation_id AS case_id, entity_id FROM entities WHERE name IS NOT NULL AND type IS NOT NULL) WHERE name <> '' GROUP BY ALL),
             s AS (SELECT l.id AS a, r.id AS b, l.type, coalesce(l.phone LIKE '%' || r.phone OR r.phone LIKE '%' || l.phone, false) AS ph, coalesce(l.value = r.value, false) AS idn, l.district AS da, r.district AS db,
               1 - levenshtein(l.name, r.name) / greatest(length(l.name), length(r.name))::DOUBLE AS name_score FROM c l JOIN c r ON l.type = r.type AND l.id < r.id
               WHERE len(list_distinct(list_concat(coalesce(l.cases, []), coalesce(r.cases, [])))) > 1),
             t AS (SELECT *, ph OR idn AS exact, ph::INT + idn::INT + (name_score >= 0.7)::INT AS pos FROM s WHERE ph OR idn OR name_score >= 0.7),
             u AS (SELECT *, coalesce(da <> db, false) AND NOT exact AND name_score < 0.9 AS conflict FROM t),
             v AS (SELECT *, CASE WHEN exact THEN least(0.99, greatest(0.60, 0.88 + 0.05::DOUBLE * (pos - 1))) ELSE least(1.0, greatest(0.0, CASE WHEN type = 'PERSON' AND NOT conflict THEN least(0.55, name_score) ELSE name_score END - CASE WHEN conflict THEN 0.15 ELSE 0.0 END)) END AS score FROM u)
             SELECT a, b, round(name_score, 6) AS name_score, round(score, 6) AS score, CASE WHEN exact AND pos > 1 THEN 'MULTI_SIGNAL' WHEN exact THEN 'EXACT_IDENTIFIER' ELSE 'FUZZY_NAME' END AS method,
             concat_ws(',', CASE WHEN ph THEN 'SHARED_PHONE' END, CASE WHEN idn THEN 'EXACT_IDENTIFIER' END, CASE WHEN name_score >= 0.7 THEN 'NAME_SIMILARITY' END, CASE WHEN conflict THEN 'CONTRADICTORY_ATTRIBUTE' END) AS factors FROM v WHERE score >= 0.6""",
        "resolution_classes": r"""WITH c AS (SELECT DISTINCT upper(type) AS t, lower(trim(regexp_replace(name, '[^\p{L}\p{Nd}]+', ' ', 'g'))) AS n, CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN regexp_replace(phone, '[^0-9]', '', 'g') END AS p,
               nullif(lower(trim(district)), '') AS d, CASE WHEN upper(type) IN ('PHONE', 'VEHICLE', 'ACCOUNT', 'EMAIL') THEN lower(trim(name)) END AS v, linked_investigation_id AS case_id, entity_id FROM entities WHERE name IS NOT NULL AND type IS NOT NULL),
             g AS (SELECT DISTINCT min(entity_id) OVER w AS class_id, entity_id FROM c WHERE n <> '' WINDOW w AS (PARTITION BY t, n, p, d, v)),
             m AS (SELECT DISTINCT class_id, entity_id, case_id FROM g JOIN (SELECT DISTINCT entity_id, case_id FROM c) USING (entity_id))
             SELECT class_id, entity_id, case_id FROM m WHERE class_id IN (SELECT class_id FROM m GROUP BY class_id HAVING count(DISTINCT case_id) > 1)""",
        "resolution_review": r"""WITH r AS (SELECT DISTINCT least(mention_a, mention_b) AS a, greatest(mention_a, mention_b) AS b, upper(regexp_replace(status, '[\s_]+', '', 'g')) AS st, status FROM resolution_candidates WHERE mention_a <> mention_b),
             e AS (SELECT entity_id, min(linked_investigation_id) AS c FROM entities WHERE linked_investigation_id IS NOT NULL GROUP BY 1)
             SELECT a, b, CASE WHEN st IN ('APPROVED', 'ACCEPTEDREPRESENTATION') THEN 'APPROVED' WHEN st = 'REJECTED' THEN 'REJECTED' ELSE 'PENDING' END AS status, CASE WHEN st IN ('APPROVED', 'ACCEPTEDREPRESENTATION') THEN 'CROSS_CASE_CONNECTION' END AS kind,
             coalesce(x.c <> y.c, false) AS across FROM r LEFT JOIN e x ON x.entity_id = a LEFT JOIN e y ON y.entity_id = b""",
        "evidence_segments": r"""WITH f AS (SELECT event_id AS i, event_type AS t, ['.json', '.csv', '.txt', '.pdf', '.bin'][event_id % 5 + 1] AS x FROM events), p AS (SELECT i || x AS path, * FROM f)
             SELECT path, 'JSON' AS file_type, 'OK' AS status, 1::INT AS segment_no, 'id: ' || i AS text FROM p WHERE x = '.json' UNION ALL SELECT path, 'JSON', 'OK', 1, '[items] type: ' || t FROM p WHERE x = '.json' UNION ALL SELECT path, 'JSON', 'OK', 2, '[items] 7' FROM p WHERE x = '.json'
             UNION ALL SELECT path, 'CSV', 'OK', 1, 'event: ' || i || '; value: ' || t FROM p WHERE x = '.csv' UNION ALL SELECT path, 'CSV', 'OK', 2, 'odd row' FROM p WHERE x = '.csv' UNION ALL SELECT path, 'TEXT', 'OK', 2, 'line ' || t FROM p WHERE x = '.txt'
             UNION ALL SELECT path, 'PDF', 'FAILED', 0, NULL FROM p WHERE x = '.pdf' UNION ALL SELECT path, NULL, 'FAILED', 0, NULL FROM p WHERE x = '.bin'""",
        "time_expressions": _time_sql(),
        "context_bundle": """WITH ent AS (SELECT min(linked_investigation_id) AS c, entity_id AS item, max(created_at) AS t FROM entities GROUP BY entity_id), pr AS (SELECT DISTINCT investigation_id AS c, id AS item, score FROM resolution_candidates),
             ev AS (SELECT DISTINCT case_id AS c, id AS item, start_time_utc AS t FROM timeline_events), pl AS (SELECT DISTINCT case_id AS c, location_entity_id AS item FROM timeline_events WHERE location_entity_id IS NOT NULL)
             SELECT c AS case_id, section, r::INT AS ord, item FROM (
             SELECT c, 'entities' AS section, item, row_number() OVER (PARTITION BY c ORDER BY t DESC NULLS LAST, item) AS r, 10 AS k FROM ent UNION ALL SELECT c, 'pairs', item, row_number() OVER (PARTITION BY c ORDER BY score DESC NULLS LAST, item), 15 FROM pr
             UNION ALL SELECT c, 'events', item, row_number() OVER (PARTITION BY c ORDER BY t ASC NULLS FIRST, item), 15 FROM ev UNION ALL SELECT c, 'places', item, row_number() OVER (PARTITION BY c ORDER BY item), 10 FROM pl
             UNION ALL SELECT investigation_id, 'documents', doc_id::VARCHAR, row_number() OVER (PARTITION BY investigation_id ORDER BY created_at DESC NULLS LAST, doc_id), 6 FROM documents) WHERE r <= k AND c IS NOT NULL""",
        "answer_levels": """WITH r AS (SELECT DISTINCT id, investigation_id, mention_a, mention_b, reviewed_by FROM resolution_candidates WHERE investigation_id IS NOT NULL),
             known AS (SELECT lower(entity_id) AS k FROM entities WHERE deleted_at IS NULL UNION SELECT lower(id) FROM users WHERE deleted_at IS NULL),
             cl AS (SELECT id, min(investigation_id) AS answer_id, CASE WHEN count(reviewed_by) > 0 THEN 'FACT' ELSE 'MODEL' END AS kind FROM r GROUP BY id),
             ci AS (SELECT id, count(*) AS n_cited, count(*) FILTER (c IN (SELECT k FROM known)) AS n_valid FROM (SELECT DISTINCT id, lower(unnest([mention_a, mention_b, reviewed_by])) AS c FROM r WHERE reviewed_by IS NOT NULL) WHERE c IS NOT NULL GROUP BY id),
             d AS (SELECT answer_id, kind, coalesce(n_cited, 0) AS n_cited, coalesce(n_valid, 0) AS n_valid, CASE WHEN coalesce(n_cited, 0) > 0 THEN n_valid > 0 ELSE kind <> 'FACT' END AS ok FROM cl LEFT JOIN ci USING (id)),
             g AS (SELECT answer_id, count(*) AS n_claims, count(*) FILTER (NOT ok) AS n_unsupported, count(*) FILTER (ok AND kind = 'MODEL') AS n_models, count(*) FILTER (ok AND kind = 'FACT' AND n_valid >= 3) AS n_evidence, count(*) FILTER (ok AND kind = 'FACT' AND n_valid = 2) AS n_relations FROM d GROUP BY answer_id)
             SELECT *, CASE WHEN n_claims = 0 THEN 'UNKNOWN' WHEN n_unsupported > 0 THEN 'LOW' WHEN n_models > 0 AND n_evidence = 0 AND n_relations = 0 THEN 'MODEL_SIGNAL' WHEN n_evidence >= 2 OR n_relations >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
             CASE WHEN n_claims = 0 THEN 0.10 WHEN n_unsupported > 0 THEN 0.35 WHEN n_models > 0 AND n_evidence = 0 AND n_relations = 0 THEN 0.55 WHEN n_evidence >= 2 OR n_relations >= 2 THEN 0.95 ELSE 0.75 END::DOUBLE AS score FROM g""",
        "resolution_connections": r"""WITH x AS (SELECT mention_a, CASE WHEN upper(regexp_replace(status, '[\s_]+', '', 'g')) IN ('APPROVED', 'ACCEPTEDREPRESENTATION') THEN 'APPROVED' WHEN upper(regexp_replace(status, '[\s_]+', '', 'g')) = 'REJECTED' THEN 'REJECTED' ELSE 'PENDING' END AS status FROM resolution_candidates)
             SELECT status, count(*) AS n, count(DISTINCT mention_a) AS n_a FROM x GROUP BY status""",
        "levenshtein_names": """SELECT id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 WHEN least(length(a), length(b)) = 0 THEN 0.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END, 6) AS ratio
             FROM (SELECT DISTINCT id, lower(regexp_replace(mention_a_name, '[^\\x00-\\x7F]', '?', 'g')) AS a, lower(regexp_replace(mention_b_name, '[^\\x00-\\x7F]', '?', 'g')) AS b FROM resolution_candidates WHERE mention_a_name IS NOT NULL AND mention_b_name IS NOT NULL)""",
        "normalise_phones": """WITH x AS (SELECT DISTINCT entity_id, name, regexp_replace(name, '[^0-9+]', '', 'g') AS kept FROM entities WHERE upper(type) = 'PHONE'),
             y AS (SELECT *, CASE WHEN kept LIKE '+%' THEN substr(kept, 2) ELSE kept END AS d0 FROM x), z AS (SELECT *, CASE WHEN length(d0) > 10 THEN CASE WHEN length(ltrim(d0, '0')) >= 10 THEN ltrim(d0, '0') ELSE right(d0, 10) END ELSE d0 END AS d FROM y)
             SELECT entity_id, CASE WHEN coalesce(name, '') = '' THEN '' WHEN length(d) = 12 AND d LIKE '91%' THEN '+' || d WHEN length(d) = 10 THEN '+91' || d WHEN kept LIKE '+%' THEN kept WHEN d <> '' THEN '+' || d ELSE trim(name) END AS phone FROM z""",
        "normalise_plates": r"SELECT upper(regexp_replace(name, '[\s\-.]', '', 'g')) AS plate, count(*) AS n FROM entities WHERE upper(type) = 'VEHICLE' GROUP BY 1",
        "text_lines": """SELECT doc_id, count(*) AS n_lines, max(no)::INT AS last_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents) WHERE trim(line) <> '' GROUP BY doc_id""",
        "csv_segments": "SELECT id, concat_ws('; ', CASE WHEN trim(classification) <> '' THEN 'classification: ' || trim(classification) END, CASE WHEN trim(priority) <> '' THEN 'priority: ' || trim(priority) END, CASE WHEN trim(district) <> '' THEN 'district: ' || trim(district) END) AS segment FROM (SELECT DISTINCT id, classification, priority, district FROM investigations)",
        "json_segments": """SELECT event_id, array_to_string(list_filter(list_transform(json_keys(props), lambda k: CASE WHEN trim(json_extract_string(props, '$.' || k)) <> '' THEN k || ': ' || json_extract_string(props, '$.' || k) END), lambda x: x IS NOT NULL), '; ') AS segment FROM events""",
        "extract_entities": f"WITH {_entities_sql()} SELECT doc_id, type, value, raw, confidence FROM ents",
        "extract_relations": _relations_sql(),
        "language_detect": r"SELECT CASE WHEN regexp_matches(text, '[\x{0900}-\x{097F}]') THEN 'mr' ELSE 'en' END AS detected, count(*) AS n FROM documents GROUP BY 1",
        "ledger_build": f"WITH RECURSIVE {_LEDGER} SELECT chain, doc_id, i::INT AS block_index, prev_hash, block_hash FROM led",
        "ledger_verify": f"WITH RECURSIVE {_LEDGER}, {_TAMPERED} SELECT chain, n_blocks, first_bad, reason FROM ver",
        "evidence_versions": "SELECT doc_id, source, row_number() OVER w::INT AS version, lag(doc_id) OVER w AS parent_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY created_at ASC NULLS FIRST, doc_id)",
        "integrity_status": f"""WITH RECURSIVE {_LEDGER}, {_TAMPERED} SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 'MISSING_FILE' WHEN t.doc_id IS NULL THEN 'MISSING_LEDGER_RECORD' WHEN sha256(d.text) <> t.content_hash THEN 'EVIDENCE_MODIFIED'
             WHEN t.chain IN (SELECT chain FROM ver WHERE reason <> 'VALID') THEN 'CHAIN_INVALID' ELSE 'VERIFIED' END AS status FROM documents d LEFT JOIN (SELECT * FROM tam WHERE doc_id % 41 <> 0) t ON t.doc_id = d.doc_id""",
        "intent_router": f"SELECT doc_id, CASE {intents} ELSE 'GENERAL_CASE_SUMMARY' END AS intent FROM (SELECT doc_id, lower(trim(text)) AS q FROM documents WHERE text IS NOT NULL)",
        "mention_extraction": """WITH q AS (SELECT doc_id, investigation_id AS c, text FROM documents WHERE text IS NOT NULL), e AS (SELECT DISTINCT linked_investigation_id AS c, name, phone FROM entities WHERE linked_investigation_id IS NOT NULL),
             quo AS (SELECT DISTINCT doc_id, trim(v) AS mention FROM (SELECT doc_id, unnest(regexp_extract_all(text, '"([^"]+)"', 1)) AS v FROM q) WHERE trim(v) <> ''),
             kn AS (SELECT DISTINCT doc_id, CASE WHEN trim(name) <> '' AND contains(lower(text), lower(name)) THEN name ELSE phone END AS mention FROM q JOIN e USING (c) WHERE (trim(name) <> '' AND contains(lower(text), lower(name))) OR (trim(phone) <> '' AND contains(lower(text), lower(phone)))),
             b AS (SELECT doc_id, mention, max(source) AS source FROM (SELECT *, 'QUOTED' AS source FROM quo UNION ALL SELECT *, 'ENTITY' FROM kn) GROUP BY 1, 2)
             SELECT * FROM b UNION ALL SELECT DISTINCT doc_id, trim(v), 'WORDS' FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?\\b', 0)) AS v FROM q WHERE doc_id NOT IN (SELECT doc_id FROM b)) WHERE length(trim(v)) > 2
             AND NOT list_contains(['what', 'when', 'where', 'which', 'who', 'whom', 'whose', 'why', 'how', 'show', 'tell', 'list', 'give', 'find', 'search', 'provide', 'explain', 'does', 'did', 'do', 'is', 'are', 'was', 'were', 'can', 'could', 'would',
             'should', 'has', 'have', 'had', 'the', 'this', 'that', 'these', 'those', 'case', 'cases', 'investigation', 'evidence', 'files', 'overview', 'summary'], lower(trim(v)))""",
        "prompt_sanitiser": r"""SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '(?i)(ignore\s+all\s+previous\s+instructions|system\s+prompt|you\s+are\s+now|act\s+as\s+a|declare\s+.*guilty)', '[DISARMED_INSTRUCTION]', 'g'))) AS said FROM documents""",
        "citation_check": """WITH r AS (SELECT concat_ws('~', least(mention_a, mention_b), greatest(mention_a, mention_b)) AS fact_id, reviewed_by AS cited FROM resolution_candidates),
             g AS (SELECT fact_id, count(DISTINCT cited) AS n_cited, count(DISTINCT cited) FILTER (cited IN (SELECT id FROM users WHERE deleted_at IS NULL)) AS n_valid FROM r GROUP BY fact_id)
             SELECT fact_id, n_cited, n_valid, CASE WHEN n_valid >= 2 THEN 'HIGH' WHEN n_valid = 1 THEN 'MEDIUM' WHEN n_cited > 0 THEN 'LOW' ELSE 'UNKNOWN' END AS confidence,
             CASE WHEN n_valid >= 2 THEN 0.95 WHEN n_valid = 1 THEN 0.75 WHEN n_cited > 0 THEN 0.35 ELSE 0.10 END::DOUBLE AS score FROM g""",
        "dashboard": """WITH ent AS (SELECT DISTINCT entity_id, linked_investigation_id AS c, risk, deleted_at FROM entities), ev AS (SELECT DISTINCT ON (id) * FROM timeline_events), nd AS (SELECT DISTINCT ON (id) * FROM graph_nodes)
             SELECT * FROM (UNPIVOT (SELECT c AS case_id, count(*) AS entities, count(*) FILTER (risk = 'CRITICAL') AS entities_critical, count(deleted_at) AS entities_deleted FROM ent WHERE c IS NOT NULL GROUP BY c) ON COLUMNS(* EXCLUDE case_id) INTO NAME measure VALUE value)
             UNION ALL SELECT * FROM (UNPIVOT (SELECT case_id, count(*) AS events, count(*) FILTER (verification_status = 'REJECTED') AS events_rejected, count(*) FILTER (start_time_utc IS NULL) AS events_without_time, count(*) FILTER (confidence < 0.7) AS events_low_confidence, count(DISTINCT location_entity_id) AS places FROM ev WHERE case_id IS NOT NULL GROUP BY case_id) ON COLUMNS(* EXCLUDE case_id) INTO NAME measure VALUE value)
             UNION ALL SELECT * FROM (UNPIVOT (SELECT investigation_id AS case_id, count(*) AS documents, count(*) FILTER (n_chars = 0) AS documents_empty, count(DISTINCT source) AS sources FROM documents WHERE investigation_id IS NOT NULL GROUP BY 1) ON COLUMNS(* EXCLUDE case_id) INTO NAME measure VALUE value)
             UNION ALL SELECT * FROM (UNPIVOT (SELECT investigation_id AS case_id, count(*) AS nodes, count(*) FILTER (trim(coalesce(entity_id, '')) = '') AS nodes_without_entity FROM nd WHERE investigation_id IS NOT NULL GROUP BY 1) ON COLUMNS(* EXCLUDE case_id) INTO NAME measure VALUE value)""",
        "case_report": f"""WITH inv AS (SELECT id, max(case_number) AS no, max(title) AS title, max(status) AS status FROM investigations GROUP BY id),
             ent AS (SELECT DISTINCT linked_investigation_id AS c, entity_id, name, type FROM entities WHERE linked_investigation_id IS NOT NULL)
             SELECT id AS case_id, 1 AS section_no, 'case' AS section, 1::BIGINT AS ord, {_cell('no')} || ',' || {_cell('title')} || ',' || {_cell('status')} AS line FROM inv
             UNION ALL SELECT c, 2, 'entities', row_number() OVER (PARTITION BY c ORDER BY name NULLS FIRST, entity_id, type NULLS FIRST), {_cell('entity_id')} || ',' || {_cell('name')} || ',' || {_cell('type')} FROM ent
             UNION ALL SELECT investigation_id, 3, 'documents', row_number() OVER (PARTITION BY investigation_id ORDER BY created_at DESC NULLS LAST, doc_id), {_cell('doc_id')} || ',' || {_cell('source')} || ',' || {_cell('n_chars')} FROM documents WHERE investigation_id IS NOT NULL""",
    }
