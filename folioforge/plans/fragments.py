"""DuckDB SQL that several queries share."""

from __future__ import annotations

from ..operators.normalize import accent_catalog

CATALOG = "(VALUES " + ", ".join(f"('{s}', '{t}', '{c}')" for s, t, c in accent_catalog()) + ") AS k(source, target, class)"
CANDIDATES = f"""(SELECT doc_id, 'V' || format('{{:05d}}', row_number() OVER (PARTITION BY doc_id ORDER BY off)) AS occurrence_id, off AS "offset", source, target, class,
  substr(text, greatest(off - 12, 0) + 1, least(off, 12) + 13) AS context
  FROM (SELECT doc_id, text, unnest(string_split(text, '')) AS ch, CAST(unnest(range(length(text))) AS INTEGER) AS off FROM documents WHERE text <> '') x JOIN {CATALOG} ON ch = source)"""
