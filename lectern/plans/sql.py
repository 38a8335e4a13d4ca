"""Pieces of SQL that the oracle queries share. The dialect's regular expressions know no look-around."""

from __future__ import annotations

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
IN = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def lstrip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+', '')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '{WS}+$', '')"


def collapsed(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'), '^ +', ''), ' +$', '')"


def normalized(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '^\x{{feff}}', ''), '\r\n?', chr(10), 'g')"


def tokens(x: str) -> str:
    inside = rf"length(regexp_replace({x}, '[^\x00-\x7f]', '', 'g'))"
    return f"greatest(1, trunc((length({x}) - {inside}) * 1.2::DOUBLE + {inside} / 3.2::DOUBLE)::INT + 1)"


EXT = r"lower(regexp_extract(regexp_extract(coalesce(name, ''), '([^/]*)$', 1), '(?s)^\.*[^.].*(\.[^.]*)$', 1))"

FILES = f"""
    f AS (SELECT file_id, any_value(name) AS name, any_value(content) AS content, any_value(job_id) AS job_id, any_value(idx) AS idx,
                 any_value(target_language) AS target_language, any_value(translated_content) AS translated_content,
                 any_value(text_eol) AS text_eol, any_value(text_bom) AS text_bom, any_value(source_sha256) AS source_sha256,
                 any_value(source_format) AS source_format
          FROM files GROUP BY file_id),
    nf AS (SELECT *, {EXT} AS ext, {normalized("content")} AS t FROM f)"""
LINES = (
    FILES
    + """,
    l AS (SELECT file_id, ext, unnest(range(len(a))) AS line_no, unnest(a) AS line
          FROM (SELECT file_id, ext, string_split(t, chr(10)) AS a FROM nf))"""
)
DOCS = f"""
    dn AS (SELECT doc_id, {normalized("text")} AS t FROM documents WHERE text IS NOT NULL),
    dl AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line
           FROM (SELECT doc_id, string_split(t, chr(10)) AS a FROM dn))"""

PLAIN = rf"'^({WS}*)([^\n]*?)([ \t]*)$'"
MARKER = r"(?:[-+*]|\p{Nd}+[.)])"
STRUCTURES = [
    rf"'^({WS}{{0,3}}#{{1,6}}[ \t]+)([^\n]*?)([ \t]*)$'",
    rf"'^({WS}*(?:>{WS}*)*{MARKER}{WS}+\[[ xX]\]{WS}+)([^\n]*?)([ \t]*)$'",
    rf"'^({WS}*(?:>{WS}*)*{MARKER}{WS}+)([^\n]*?)([ \t]*)$'",
    rf"'^({WS}*(?:>{WS}*)+)([^\n]*?)([ \t]*)$'",
    PLAIN,
]
FENCE = rf"'^{WS}*(?:```|~~~)'"
RULE = rf"'^{WS}{{0,3}}(?:(?:\*{WS}*){{3,}}|(?:-{WS}*){{3,}}|(?:_{WS}*){{3,}})$'"
TIMING = r"'^[\s\x{0b}\x{85}\p{Z}]*(?:\p{Nd}{1,3}:)?\p{Nd}{2}:\p{Nd}{2}[,.]\p{Nd}{3}[\s\x{0b}\x{85}\p{Z}]+-->[\s\x{0b}\x{85}\p{Z}]+(?:\p{Nd}{1,3}:)?\p{Nd}{2}:\p{Nd}{2}[,.]\p{Nd}{3}(?:[\s\x{0b}\x{85}\p{Z}]+.*)?$'"


def structure(i: int, line: str = "line") -> str:
    """Part i of the first structure that matches."""
    cases = " ".join(f"WHEN regexp_matches({line}, {p}) THEN regexp_extract({line}, {p}, {i})" for p in STRUCTURES[:-1])
    return f"CASE {cases} ELSE regexp_extract({line}, {STRUCTURES[-1]}, {i}) END"


FENCED = f"""
    fe AS (SELECT *, coalesce(sum(is_fence::INT) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence
           FROM (SELECT *, regexp_matches(line, {FENCE}) AS is_fence FROM l))"""
MARKDOWN = (
    FENCED
    + rf""",
    md0 AS (SELECT file_id, ext, line_no, line,
                  regexp_matches(line, {FENCE}) OR in_fence OR {strip("line")} = '' OR regexp_matches(line, '^(?:    |\t)') OR regexp_matches(line, {RULE}) AS locked,
                  {structure(1)} AS prefix, {structure(2)} AS text, {structure(3)} AS suffix
           FROM fe WHERE ext NOT IN ('.srt', '.vtt', '.docx', '.epub', '.pdf')),
    md AS (SELECT file_id, ext, line_no, line, NOT locked AND text <> '' AS translate, prefix, text, suffix FROM md0)"""
)
SUBTITLE = rf"""
    su0 AS (SELECT *, {strip("line")} AS s, regexp_matches(line, {TIMING}) AS timing FROM l WHERE ext IN ('.srt', '.vtt')),
    su1 AS (SELECT *, s = '' AS blank, max(line_no = 0 AND starts_with(s, 'WEBVTT')) OVER (PARTITION BY file_id) AS opened,
                   min(CASE WHEN s = '' AND line_no > 0 THEN line_no END) OVER (PARTITION BY file_id) AS first_blank,
                   CASE WHEN regexp_matches(s, '^(?:NOTE(?:{WS}|$)|STYLE$|REGION$)') THEN 1 WHEN s = '' THEN 0 END AS event FROM su0),
    su2 AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state,
                   coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM su1),
    su3 AS (SELECT *, ext = '.vtt' AND opened AND line_no <= coalesce(first_blank, line_no) AS header, ext = '.vtt' AND (state = 1 OR (blank AND earlier = 1)) AS block FROM su2),
    su4 AS (SELECT *, coalesce(lead(timing AND NOT block) OVER (PARTITION BY file_id ORDER BY line_no), false) AND NOT blank AND (ext = '.vtt' OR regexp_matches(s, '^\p{{Nd}}+$')) AS cue FROM su3),
    su AS (SELECT file_id, ext, line_no, line, NOT (header OR block OR blank OR timing OR cue) AND regexp_extract(line, {PLAIN}, 2) <> '' AS translate,
                  regexp_extract(line, {PLAIN}, 1) AS prefix, regexp_extract(line, {PLAIN}, 2) AS text, regexp_extract(line, {PLAIN}, 3) AS suffix FROM su4)"""
UNITS = (
    LINES
    + ","
    + MARKDOWN
    + ","
    + SUBTITLE
    + f""",
    bi AS (SELECT file_id, ext, line_no, line, regexp_extract(line, {PLAIN}, 2) <> '' AS translate, regexp_extract(line, {PLAIN}, 1) AS prefix,
                  regexp_extract(line, {PLAIN}, 2) AS text, regexp_extract(line, {PLAIN}, 3) AS suffix FROM l WHERE ext IN ('.docx', '.epub', '.pdf')),
    u AS (SELECT file_id, ext, line_no, line, translate, CASE WHEN translate THEN prefix END AS prefix, CASE WHEN translate THEN text END AS text,
                 CASE WHEN translate THEN suffix END AS suffix FROM (SELECT * FROM md UNION ALL SELECT * FROM su UNION ALL SELECT * FROM bi))"""
)

SENTENCES = rf"'(?s).+?(?:[。！？.!?]+[”’\"」』）)\]]*{WS}*|$)'".replace('\\"', '"')


def pieces(source: str, keys: str, limit: int) -> str:
    """CTEs up to pc(keys, piece, unit): the lines `text` of source as requests, those above the limit cut by recursion.

    From each place to the furthest sentence end within the limit, else to the last blank of the upper half of what fits.
    """
    return f"""
    lx AS (SELECT {keys}, text, regexp_extract_all(text, {SENTENCES}) AS s FROM {source} WHERE {tokens("text")} > {limit}),
    le AS (SELECT {keys}, text, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: length(x)))::BIGINT) AS ends FROM lx),
    lr AS (SELECT {keys}, text, ends, 0::BIGINT AS place, 0 AS piece, ''::VARCHAR AS unit FROM le
           UNION ALL
           SELECT {keys}, text, ends, stop + length(rest) - length({lstrip("rest")}), piece + (cut <> '')::INT, cut
           FROM (SELECT *, substr(text, stop + 1) AS rest, {strip("substr(text, place + 1, stop - place)")} AS cut
                 FROM (SELECT *, coalesce(fit, CASE WHEN contains(seg, ' ') AND low + length(regexp_extract(seg, '(?s)^(.*) [^ ]*$', 1)) > place
                                                THEN low + length(regexp_extract(seg, '(?s)^(.*) [^ ]*$', 1)) ELSE place + room END) AS stop
                       FROM (SELECT *, place + greatest(1, room // 2) AS low, substr(text, place + greatest(1, room // 2) + 1, room + 1 - greatest(1, room // 2)) AS seg
                             FROM (SELECT *, greatest(1, (near - place) * {limit} // {tokens("substr(text, place + 1, near - place)")}) AS room
                                   FROM (SELECT *, list_min(list_filter(ends, lambda e: e > place)) AS near,
                                                list_max(list_filter(list_filter(ends, lambda e: e > place AND e <= place + {4 * limit}), lambda e: {tokens("substr(text, place + 1, e - place)")} <= {limit})) AS fit
                                         FROM lr WHERE place < length(text))))))),
    pc AS (SELECT {keys}, 0 AS piece, text AS unit FROM {source} WHERE {tokens("text")} <= {limit}
           UNION ALL SELECT {keys}, piece - 1, unit FROM lr WHERE unit <> '')"""
