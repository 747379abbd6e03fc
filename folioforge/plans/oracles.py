"""DuckDB SQL for the queries of :mod:`folioforge.plans.queries`, written independently of their plans."""

from __future__ import annotations

from ..operators.normalize import APPROVED, accent_catalog
from .fragments import CANDIDATES

COMMENT, OPAQUE, TAG = r"(?s)<!--.*?-->", r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", r"</?[A-Za-z][A-Za-z0-9:]*[^<>]*>"
LINK = r"(?is)<a[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>".replace("\\\"", '"')

PARAGRAPHS = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS p, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS pos FROM documents)"
BARE = f"regexp_replace(html, '{COMMENT}', '', 'g')"


def visible(html: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({html}, '{COMMENT}', '', 'g'), '{OPAQUE}', ' ', 'g'), '{TAG}', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"


TAGS = f"""(SELECT page_id, seq, lower(regexp_extract(tag, '^</?([A-Za-z][A-Za-z0-9:]*)', 1)) AS name, starts_with(tag, '</') AS closing, ends_with(tag, '/>') AS self_closing
  FROM (SELECT page_id, unnest(regexp_extract_all({BARE}, '{TAG}')) AS tag, CAST(unnest(range(len(regexp_extract_all({BARE}, '{TAG}')))) AS INTEGER) AS seq FROM pages))"""
OPEN_TAGS = f"(SELECT * FROM {TAGS} WHERE NOT self_closing AND name NOT IN ('br', 'hr', 'img', 'input', 'meta', 'link'))"
NODES = """(SELECT conv_id AS paragraph_id, turn AS ord, CASE role WHEN 'user' THEN 'insert' WHEN 'assistant' THEN 'delete' ELSE 'text' END AS kind,
  role AS style, coalesce(text, '') AS text FROM conversations)"""
CELLS = """(SELECT l_orderkey AS t, r, c, CASE c WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice ELSE l_discount END AS value, 1 AS span
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) - 1 AS INTEGER) AS r FROM lineitem),
  (VALUES (0), (1), (2)) AS k(c))"""
DECISIONS = "(SELECT doc_id AS item_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'defer' END AS decision FROM labels)"
EASY = [(s, t) for s, t, c in accent_catalog() if c == APPROVED]

JOURNAL = """o AS (SELECT user_id, event_id, event_id || '|' || event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  j AS (SELECT user_id, event_id, k, repeat('0', 64) AS prev_sha, sha256(repeat('0', 64) || '|' || payload) AS record_sha FROM o WHERE k = 1
        UNION ALL SELECT o.user_id, o.event_id, o.k, j.record_sha, sha256(j.record_sha || '|' || o.payload) FROM o JOIN j ON o.user_id = j.user_id AND o.k = j.k + 1)"""


def grid_sql(select: str) -> str:
    return f"WITH cells AS (SELECT * FROM {CELLS}) {select}"


ORACLES = {
    "paragraph_inventory": f"""SELECT doc_id, pos, 'P' || pos AS paragraph_id, CAST(length(p) AS INTEGER) AS n_chars, substr(sha256(p), 1, 12) AS fingerprint, p = '' AS is_empty FROM {PARAGRAPHS}""",
    "paragraph_listing": f"""SELECT doc_id, pos, substr(p, 1, 60) AS summary, CAST(length(p) AS INTEGER) AS n_chars, CAST(len(regexp_extract_all(p, '[0-9]+')) AS INTEGER) AS n_numbers FROM {PARAGRAPHS}""",
    "document_summary": f"""SELECT doc_id, CAST(count(*) AS INTEGER) AS n_paragraphs, CAST(sum(length(p)) AS INTEGER) AS n_chars,
        CAST(count(*) FILTER (p = '') AS INTEGER) AS n_empty, CAST(max(length(p)) AS INTEGER) AS longest FROM {PARAGRAPHS} GROUP BY doc_id""",
    "duplicate_signature": "SELECT sha256(text) AS signature, count(*) AS members, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "tag_scan": f"SELECT * FROM {TAGS}",
    "tag_balance": f"SELECT page_id, name, count(*) FILTER (NOT closing) AS opened, count(*) FILTER (closing) AS closed FROM {OPEN_TAGS} GROUP BY ALL HAVING opened <> closed",
    "tag_depth": f"SELECT page_id, CAST(max(d) AS BIGINT) AS max_depth FROM (SELECT page_id, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY seq) AS d FROM {OPEN_TAGS}) GROUP BY page_id",
    "markup_visible_text": f"SELECT page_id, {visible('html')} AS visible FROM pages",
    "hyperlink_inventory": f"""SELECT page_id, seq, regexp_extract(a, '{LINK}', 1) AS href, {visible(f"regexp_extract(a, '{LINK}', 2)")} AS label
        FROM (SELECT page_id, unnest(regexp_extract_all({BARE}, '{LINK}')) AS a, CAST(unnest(range(len(regexp_extract_all({BARE}, '{LINK}')))) AS INTEGER) AS seq FROM pages)""",
    "opaque_inventory": f"""SELECT page_id, CAST(count(*) AS INTEGER) AS n_opaque, CAST(sum(length(o)) AS INTEGER) AS opaque_chars
        FROM (SELECT page_id, unnest(regexp_extract_all({BARE}, '{OPAQUE}')) AS o FROM pages) GROUP BY page_id""",
    "attach_preceding": f"""WITH t AS (SELECT * FROM {TAGS}), h AS (SELECT page_id, seq AS at FROM t WHERE name IN ('p', 'h1', 'h2', 'div') AND NOT closing)
        SELECT t.page_id, t.seq, t.name, h.at AS attached_to FROM t ASOF LEFT JOIN h ON t.page_id = h.page_id AND t.seq >= h.at""",
    "anchor_pairing": f"""WITH t AS (SELECT page_id, closing, seq, row_number() OVER (PARTITION BY page_id, closing ORDER BY seq) AS k FROM {TAGS} WHERE name = 'p'),
        s AS (SELECT page_id || '-' || k AS id, seq FROM t WHERE NOT closing), e AS (SELECT page_id || '-' || k AS id, seq FROM t WHERE closing)
        SELECT coalesce(s.id, e.id) AS id, CASE WHEN e.id IS NULL THEN 'anchor-not-closed' WHEN s.id IS NULL THEN 'anchor-not-opened' ELSE 'anchor-reversed' END AS code
        FROM s FULL JOIN e ON s.id = e.id WHERE e.id IS NULL OR s.id IS NULL OR s.seq > e.seq""",
    "final_view": f"SELECT paragraph_id, string_agg(text, '' ORDER BY ord) AS final_text, count(*) AS n_nodes FROM {NODES} WHERE kind <> 'delete' GROUP BY paragraph_id",
    "original_view": f"SELECT paragraph_id, string_agg(text, '' ORDER BY ord) AS original_text, count(*) AS n_nodes FROM {NODES} WHERE kind <> 'insert' GROUP BY paragraph_id",
    "clean_view": f"SELECT paragraph_id, '--- ' || paragraph_id || ' ---' || chr(10) || string_agg(text, chr(10) ORDER BY ord) AS clean_text FROM {NODES} WHERE kind <> 'delete' GROUP BY paragraph_id",
    "style_view": f"SELECT paragraph_id, string_agg('[' || style || ']' || text || '[/' || style || ']', '' ORDER BY ord) AS styled_text FROM {NODES} WHERE kind <> 'delete' GROUP BY paragraph_id",
    "node_skeleton": f"SELECT paragraph_id, string_agg(kind || ':' || style, '|' ORDER BY ord) AS skeleton FROM {NODES} GROUP BY paragraph_id",
    "revision_inventory": f"""SELECT paragraph_id, ord, kind, style AS author, CAST(length(text) AS INTEGER) AS n_chars,
        paragraph_id || '|' || kind || '|' || ord || '|' || substr(sha256(text), 1, 12) AS revision_key FROM {NODES} WHERE kind <> 'text'""",
    "accept_all": f"SELECT paragraph_id, ord, 'text' AS kind, style, text FROM {NODES} WHERE kind <> 'delete'",
    "reject_all": f"SELECT paragraph_id, ord, 'text' AS kind, style, text FROM {NODES} WHERE kind <> 'insert'",
    "settle_some": f"""SELECT paragraph_id, ord, CASE WHEN ord % 5 = 0 OR ord % 2 = 0 THEN 'text' ELSE kind END AS kind, style, text FROM {NODES}
        WHERE NOT (kind = 'insert' AND ord % 5 = 0) AND NOT (kind = 'delete' AND ord % 5 <> 0 AND ord % 2 = 0)""",
    "style_weighted_mode": f"""WITH n AS (SELECT paragraph_id // 10 AS document, *, kind <> 'delete' AS shown FROM {NODES}),
        c AS (SELECT document, paragraph_id, style, CAST(sum(length(text)) AS BIGINT) AS chars, min(ord) AS first FROM n WHERE shown GROUP BY ALL),
        b AS (SELECT document, paragraph_id, arg_max(style, (chars, -first)) AS own, max(chars) AS chars FROM c GROUP BY ALL),
        p AS (SELECT document, paragraph_id, CAST(sum(CASE WHEN kind = 'text' THEN length(text) ELSE 0 END) AS BIGINT) AS visible_chars FROM n GROUP BY ALL)
        SELECT p.document, p.paragraph_id, coalesce((SELECT arg_max(x.own, x.paragraph_id) FROM b x WHERE x.document = p.document AND x.paragraph_id <= p.paragraph_id), 'Normal') AS base_style, coalesce(b.chars, 0) AS base_chars, visible_chars FROM p LEFT JOIN b USING (document, paragraph_id)""",
    "style_regions": f"""WITH s AS (SELECT *, CASE WHEN style IS NOT DISTINCT FROM lag(style) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM {NODES} WINDOW w AS (PARTITION BY paragraph_id ORDER BY ord)),
        g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY paragraph_id ORDER BY ord) - 1 AS BIGINT) AS region FROM s)
        SELECT paragraph_id, region, min(style) AS style, min(ord) AS first_ord, count(*) AS n_nodes, string_agg(text, '' ORDER BY ord) AS text FROM g GROUP BY paragraph_id, region""",
    "apply_decisions": f"""SELECT doc_id AS item_id, coalesce(decision, 'none') AS decision, CASE WHEN decision IN ('accept', 'reject') THEN 'published' WHEN decision = 'defer' THEN 'not_attempted' ELSE 'pending' END AS status
        FROM documents LEFT JOIN {DECISIONS} d ON doc_id = item_id""",
    "decision_violations": """SELECT doc_id AS item_id, 'revision-not-found' AS code FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT doc_id, 'duplicate-decision' FROM labels GROUP BY doc_id HAVING count(*) > 1
        UNION ALL SELECT doc_id, 'decision-pending' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "candidate_scan": f"SELECT * FROM {CANDIDATES}",
    "normalize_apply": f"""SELECT doc_id, translate(text, '{"".join(s for s, _ in EASY)}', '{"".join(t for _, t in EASY)}') AS normalized,
        CAST(len(regexp_extract_all(text, '[{"".join(s for s, _ in EASY)}]')) AS INTEGER) AS n_converted FROM documents WHERE text IS NOT NULL""",
    "normalize_audit": f"""SELECT doc_id, occurrence_id, CASE WHEN class = 'approved' THEN 'convert' ELSE 'preserve' END AS action, CASE WHEN class = 'approved' THEN '' ELSE 'class:' || class END AS reason FROM {CANDIDATES}""",
    "unique_text_match": """SELECT item_id, count(doc_id) AS n_docs, CASE count(doc_id) WHEN 0 THEN 'text-not-found' WHEN 1 THEN 'ok' ELSE 'text-ambiguous' END AS code
        FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id""",
    "grid_insert_row": grid_sql("SELECT t, CASE WHEN r > 0 THEN r + 1 ELSE r END AS r, c, value, span FROM cells UNION ALL SELECT t, r + 1, c, NULL, 1 FROM cells WHERE r = 0"),
    "grid_delete_row": grid_sql("SELECT t, CASE WHEN r > 1 THEN r - 1 ELSE r END AS r, c, value, span FROM cells WHERE r <> 1"),
    "grid_insert_col": grid_sql("SELECT t, r, CASE WHEN c > 1 THEN c + 1 ELSE c END AS c, value, span FROM cells UNION ALL SELECT t, r, c + 1, NULL, 1 FROM cells WHERE c = 1"),
    "grid_delete_col": grid_sql("SELECT t, r, CASE WHEN c > 1 THEN c - 1 ELSE c END AS c, value, span FROM cells WHERE c <> 1"),
    "grid_merge_cells": grid_sql("SELECT t, r, CASE WHEN r = 0 AND c >= 2 THEN c - 1 ELSE c END AS c, value, CASE WHEN r = 0 AND c = 0 THEN 2 ELSE span END AS span FROM cells WHERE NOT (r = 0 AND c = 1)"),
    "grid_split_cell": grid_sql("""SELECT t, r, CASE WHEN r = 1 AND c > 1 THEN c + 2 ELSE c END AS c, value, span FROM cells
        UNION ALL SELECT t, r, k.c, NULL, 1 FROM cells, (VALUES (2), (3)) AS k(c) WHERE r = 1 AND cells.c = 1"""),
    "grid_render": grid_sql("SELECT t, r, max(value) FILTER (c = 0) AS c0, max(value) FILTER (c = 1) AS c1, max(value) FILTER (c = 2) AS c2 FROM cells GROUP BY t, r"),
    "merge_violations": grid_sql("""SELECT t, CASE WHEN found < 2 THEN 'invalid-table-reference' ELSE 'merge-would-discard-content' END AS code, lost FROM (
        SELECT t, count(*) FILTER (r = 2 AND c IN (1, 2)) AS found, count(*) FILTER (r = 2 AND c = 2 AND value IS NOT NULL) AS lost FROM cells GROUP BY t) WHERE found < 2 OR lost > 0"""),
    "event_upsert_latest": """SELECT user_id, event_id, event_type, value, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""".replace("value, n FROM", "value, n AS n_events FROM"),
    "event_counts": """SELECT s AS status, count(event_id) AS n FROM (VALUES ('click'), ('purchase'), ('view'), ('signup'), ('error'), ('settled')) AS d(s) LEFT JOIN events ON lower(event_type) = s GROUP BY s""",
    "event_dispatch": """SELECT event_id, CASE WHEN value < 20 THEN 'acknowledged' WHEN value < 60 THEN 'queued' ELSE 'settled' END AS status, CASE WHEN value < 20 THEN 'b1' ELSE 'b0' END AS batch_id FROM events""",
    "snapshot_chain_check": """SELECT o_custkey, o_orderkey AS id, o_orderkey AS parent_id, expected, 'current-parent-mismatch' AS code FROM (
        SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS expected FROM orders) WHERE o_orderkey % 50 = 0""",
    "ledger_replay": """WITH c AS (SELECT user_id || '-' || event_type AS op_id, sha256(CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR)) AS input_sha, event_id FROM events)
        SELECT op_id, count(*) AS calls, count(DISTINCT input_sha) AS inputs, arg_min(input_sha, event_id) AS kept_input,
        CASE WHEN count(DISTINCT input_sha) > 1 THEN 'operation-id-reused' WHEN count(*) > 1 THEN 'replayed' ELSE 'recorded' END AS code FROM c GROUP BY op_id""",
    "journal_chain": f"WITH RECURSIVE {JOURNAL} SELECT user_id, event_id, record_sha, prev_sha FROM j",
    "journal_check": f"""WITH RECURSIVE {JOURNAL}, left_ AS (SELECT *, lag(record_sha) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM j WHERE event_id % 90 <> 1)
        SELECT user_id, event_id, CASE WHEN event_id % 50 = 0 THEN 'record-hash-mismatch' ELSE 'chain-broken' END AS code FROM left_ WHERE event_id % 50 = 0 OR prev_sha <> coalesce(before, repeat('0', 64))""",
    "event_drafts": """WITH e AS (SELECT *, (SELECT count(*) FROM events p WHERE p.user_id = x.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) < (x.ts, x.event_id)) AS draft FROM events x)
        SELECT user_id, draft, arg_min(event_id, (ts, event_id)) FILTER (event_type <> 'purchase') AS event_id, count(*) FILTER (event_type <> 'purchase') AS n_writes, bool_or(event_type = 'purchase') AS sent,
        arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'purchase') AS event_type, arg_max(value, (ts, event_id)) FILTER (event_type <> 'purchase') AS value FROM e GROUP BY user_id, draft HAVING count(*) FILTER (event_type <> 'purchase') > 0""",
    "recovery_decision": """SELECT o_orderkey AS tx, o_orderkey % 3 AS current, o_orderkey % 2 AS prepared, CAST(2 AS BIGINT) AS parent,
        CASE WHEN o_orderkey % 3 = o_orderkey % 2 THEN 'forward' WHEN o_orderkey % 3 = 2 THEN 'back' ELSE 'needs-recovery' END AS decision FROM orders""",
    "sync_splice": """SELECT id, after AS text FROM (SELECT conv_id || '-' || role || '-' || turn AS id, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before, text AS after FROM conversations) WHERE before IS NOT NULL AND after IS NOT NULL""",
    "grapheme_count": r"""SELECT conv_id, turn, CAST(len(regexp_extract_all(coalesce(text, ''), '(?:\x{200D}+(?:\r\n|[\x{1F1E6}-\x{1F1FF}]{2}|(?s:.))?|\r\n|[\x{1F1E6}-\x{1F1FF}]{2}|(?s:.))(?:\p{M}+|\x{200D}+(?:\r\n|[\x{1F1E6}-\x{1F1FF}]{2}|(?s:.))?)*')) AS INTEGER) AS n_units FROM conversations""",
    "utf16_fnv1a": """WITH u AS (SELECT item_id, flatten(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE WHEN c = '' THEN [] WHEN unicode(c) < 65536 THEN [unicode(c)] ELSE [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] END)) AS units FROM benchmark WHERE text IS NOT NULL)
        SELECT item_id, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(units, lambda x: x::BIGINT)), lambda a, x: (xor(a, x) * 16777619) % 4294967296))), 8, '0') AS fingerprint FROM u UNION ALL SELECT item_id, NULL FROM benchmark WHERE text IS NULL""",
    "resource_violations": f"""WITH s AS (SELECT doc_id, count(*) AS n_paragraphs, CAST(sum(length(p)) AS BIGINT) AS n_chars, max(length(p)) AS longest FROM {PARAGRAPHS} GROUP BY doc_id)
        SELECT doc_id, 'n_chars' AS dimension, n_chars AS actual, CAST(4000 AS BIGINT) AS max_allowed FROM s WHERE n_chars > 4000
        UNION ALL SELECT doc_id, 'n_paragraphs', n_paragraphs, 12 FROM s WHERE n_paragraphs > 12 UNION ALL SELECT doc_id, 'longest', longest, 1200 FROM s WHERE longest > 1200""",
    "retention_check": f"""WITH k AS (SELECT doc_id % 2 AS side, doc_id // 2 AS key, pos, sha256(p) AS sig FROM {PARAGRAPHS})
        SELECT key, pos, CASE WHEN count(*) FILTER (side = 0) = 0 THEN 'added' WHEN count(*) FILTER (side = 1) = 0 THEN 'removed' WHEN count(DISTINCT sig) = 1 THEN 'kept' ELSE 'changed' END AS outcome
        FROM k GROUP BY key, pos""",
    "freshness_state": """SELECT o_orderkey, CASE WHEN b = l AND b = s THEN 'clean' WHEN b = l THEN 'dirty' WHEN b = s THEN 'stale-clean' ELSE 'conflict' END AS state
        FROM (SELECT o_orderkey, o_custkey % 2 AS b, o_orderkey % 2 AS l, length(o_orderpriority) % 2 AS s FROM orders)""",
    "tombstone_completeness": """WITH l AS (SELECT doc_id FROM labels WHERE quality = 1), d AS (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)
        SELECT doc_id AS id, 'missing-tombstone' AS code FROM documents WHERE doc_id NOT IN (FROM l) AND doc_id NOT IN (FROM d)
        UNION ALL SELECT doc_id, 'unknown-delete' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'live-and-deleted' FROM l WHERE doc_id IN (FROM d)""",
    "lowest_free_ids": """WITH u AS (SELECT DISTINCT l_orderkey AS g, CAST(l_linenumber AS INTEGER) AS id FROM lineitem),
        f AS (SELECT g, CAST(k.id AS INTEGER) AS id FROM (SELECT DISTINCT g FROM u), range(1, 100) AS k(id) WHERE (g, k.id) NOT IN (SELECT (g, id) FROM u))
        SELECT g, id, CAST(row_number() OVER (PARTITION BY g ORDER BY id) AS INTEGER) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY g ORDER BY id) <= 2""",
    "box_containment": f"""WITH t AS (SELECT * FROM {TAGS}), p AS (SELECT page_id, seq, coalesce(lead(seq) OVER (PARTITION BY page_id ORDER BY seq), 1073741824) AS stop FROM t WHERE name = 'p' AND NOT closing)
        SELECT a.page_id AS g, a.seq AS at, p.seq AS start, CAST(p.stop AS INTEGER) AS stop, p.seq AS id FROM t a JOIN p ON a.page_id = p.page_id AND p.seq <= a.seq AND a.seq < p.stop WHERE a.name IN ('b', 'br') AND NOT a.closing""",
}

from .governance import ORACLES as _GOVERNANCE  # noqa: E402
from .review import ORACLES as _REVIEW  # noqa: E402
from .structure import ORACLES as _STRUCTURE  # noqa: E402
from .typed import ORACLES as _TYPED  # noqa: E402

ORACLES.update(_STRUCTURE | _REVIEW | _GOVERNANCE | _TYPED)
