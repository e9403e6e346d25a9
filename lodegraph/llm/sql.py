"""SQL that checks the problems on texts, as far as SQL can express them: the key of texts that look the same, and what must hold of the others."""

from __future__ import annotations

from lodegraph.llm import canonical as C
from lodegraph.llm.syntax import LANGUAGES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replaced(expression: str, table: dict[int, str]) -> str:
    """An expression with characters replaced: single ones at once, the others one after the other."""
    one = {k: v for k, v in table.items() if len(v) == 1}
    out = f"translate({expression}, {_q(''.join(map(chr, one)))}, {_q(''.join(one.values()))})" if one else expression
    for k, v in table.items():
        if len(v) != 1:
            out = f"replace({out}, {_q(chr(k))}, {_q(v)})"
    return out


def _look(text: str) -> str:
    """The key by which texts look the same; joiners are dropped wherever they stand."""
    seen = "[" + C.INVISIBLE + "‌‍]"
    wide = {k: v for k, v in C._folds().items() if 0x2000 <= k < 0x10000 or k < 0x2000}
    out = f"regexp_replace({_replaced(text, C._look_map())}, {_q(seen)}, '', 'g')"
    out = f"nfc_normalize({_replaced(out, wide)})"
    return f"nfc_normalize({_replaced(_replaced(out, C._plain()), C._look_map())})"


_EXT = "lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1))"
_CODE = f"{_EXT} IN ({', '.join(map(_q, LANGUAGES))})"

ORACLES = {
    "p8_found": f"""WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text <> ''), k AS (SELECT doc_id, text, {_look('text')} AS look FROM t)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p8_classes": f"""WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text <> ''), k AS (SELECT doc_id, md5(text) AS text_class, {_look('text')} AS look FROM t),
c AS (SELECT look, count(*) AS total FROM k GROUP BY 1 HAVING count(DISTINCT text_class) > 1), e AS (SELECT look, text_class, count(*) AS n FROM k GROUP BY ALL)
SELECT doc_id, text_class, total - n AS links FROM k JOIN c USING (look) JOIN e USING (look, text_class)""",
    # what masking must keep of every file, and which files each judgement is about
    "p1_kept": "SELECT DISTINCT file_id, length(content) AS chars, length(content) - length(replace(content, chr(10), '')) AS line_ends FROM files",
    "p2_judged": f"SELECT DISTINCT file_id, {_EXT} AS ext FROM files WHERE file_id IS NOT NULL AND content IS NOT NULL AND {_CODE}",
    "p3_judged": f"SELECT DISTINCT file_id, path FROM files WHERE file_id IS NOT NULL AND {_CODE}",
    "p5_bounds": "SELECT 0::BIGINT AS beyond, 0::BIGINT AS unknown_languages, 0::BIGINT AS no_code",
    "p8_stable": "SELECT count(*) AS texts, 0::BIGINT AS unstable, count(*) FILTER (text IS NULL) AS nulls FROM documents",
}
