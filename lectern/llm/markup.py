"""One scanner for the markup of HTML, Markdown, wiki text, LaTeX and subtitle files.

scan(text) labels every physical line, so that the other operators know which lines hold words that somebody wrote and
which hold code, cues, tags, templates, formulas, numbers or rules. plain(line) drops inline markup from one line.
"""

from __future__ import annotations

import re

BLANK, CUE, CODE, TAG, TEMPLATE, FORMULA, NUMBER, RULE, TEXT = range(9)

FENCE = re.compile(r"[ ]{0,3}(?:> ?)*(`{3,}|~{3,})(.*)$")
TIMING = re.compile(r"\s*(?:\d+:)?\d{1,2}:\d{2}[.,]\d{3}\s*-->\s*(?:\d+:)?\d{1,2}:\d{2}[.,]\d{3}.*$")
CUE_HEAD = re.compile(r"(?:WEBVTT\b.*|NOTE\b.*|STYLE|REGION)$")
# Blocks of code that markup opens and closes by name: opening pattern, closing pattern.
_BLOCKS = re.compile(r"<(pre|syntaxhighlight|source|script|style)\b(?![^<>]*/>)[^<>]*>|\\begin\{(lstlisting|verbatim\*?|minted|Verbatim)\}", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
TAGS = re.compile(r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s+[^<>]*|\s*/)?>")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_FORMULA = re.compile(r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|<math\b[^<>]*>.*?</math>|(?<![\\$A-Za-z0-9])\$(?=[^\s$])[^$\n]*[\\^_={}+][^$\n]*(?<=[^\s$])\$(?![\d$])", re.S)
_MATH_ENV = re.compile(r"\\(begin|end)\{(equation|align|gather|displaymath|math|eqnarray|multline)\*?\}")
_COMMAND = re.compile(r"\\(?:cite|ref|label|eqref|begin|end|url|includegraphics|usepackage|documentclass)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}(?:\[[^\]\n]*\])?|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?=[{\s\\]|$)")
_URL = re.compile(r"\b(?:https?|ftp)://[^\s<>()\[\]\"']+|\b[\w.+-]+@[\w-]+\.[\w.]+", re.A)
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_WIKI = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_DATA = re.compile(r"\{[A-Za-z_]+\d*\}|%\w\b|\b\w+(?:_\w+)+\b|\b\w+\.[A-Za-z]\w*(?:\.\w+)*\b|[A-Za-z]:\\\S+", re.A)
_ENCODED = re.compile(r"(?<![^\s\"'(])[A-Za-z0-9+/=_.:-]{40,}")
_LETTERS = re.compile(r"[^\W\d_]")
_MARKS = re.compile(r"[*_`~#>|=+\[\]{}]+")


def plain(line: str) -> str:
    """The words of one line without tags, links' targets, templates, formulas, commands, addresses and placeholders."""
    if "<" in line:
        line = TAGS.sub(" ", _FORMULA.sub(" ", line) if "math" in line else line)
    if "&" in line:
        line = _ENTITY.sub(" ", line)
    if "{{" in line:
        line = _TEMPLATE.sub(" ", line)
    if "$" in line or "\\" in line:
        line = _COMMAND.sub(" ", _FORMULA.sub(" ", line))
    if "[" in line:
        line = _WIKI.sub(r"\1", _LINK.sub(r"\1", line))
    if "//" in line or "@" in line:
        line = _URL.sub(" ", line)
    if len(line) > 40:
        line = _ENCODED.sub(" ", line)
    if "_" in line or "." in line or "{" in line or "\\" in line:
        line = _DATA.sub(" ", line)
    return line


def _block_end(name: str) -> re.Pattern:
    return re.compile((r"</%s\s*>" if name.isalpha() and name.lower() not in ("lstlisting", "minted", "verbatim") else r"\\end\{%s\}") % re.escape(name), re.I)


def scan(lines: list[str]) -> list[int]:
    """The kind of each line. Code covers the delimiters of its block; an open block runs to the end."""
    kinds: list[int] = []
    fence = ""
    end: re.Pattern | None = None
    maths = note = comment = False
    depth = tag = 0
    vtt = bool(lines) and lines[0].startswith("WEBVTT")
    for i, line in enumerate(lines):
        s = line.strip()
        if fence:
            kinds.append(CODE)
            if s.lstrip("> ").startswith(fence) and not s.lstrip("> ").strip(fence[0]):
                fence = ""
            continue
        if end:
            kinds.append(CODE)
            if end.search(line):
                end = None
            continue
        if comment:
            kinds.append(TAG)
            comment = "-->" not in line
            continue
        if not s:
            kinds.append(BLANK)
            note = False
            continue
        c = s[0]
        if maths:
            kinds.append(FORMULA)
            if (m := _MATH_ENV.search(s)) and m[1] == "end" or s.endswith(("$$", "\\]")):
                maths = False
            continue
        if vtt and (i == 0 or note or CUE_HEAD.match(s)):
            note = i == 0 or note or s.startswith(("NOTE", "STYLE", "REGION"))
            kinds.append(CUE)
            continue
        if "-->" in s and TIMING.match(s):
            kinds.append(CUE)
            continue
        if (c in "`~>") and (m := FENCE.match(line)):
            kinds.append(CODE)
            if "`" not in m[2]:
                fence = m[1]
            else:
                kinds[-1] = TEXT
            continue
        if ("<" in s or c == "\\") and (m := _BLOCKS.search(s)):
            e = _block_end(m[1] or m[2])
            if not e.search(s, m.end()):
                end = e
            rest = s[: m.start()] + (s[e.search(s, m.end()).end() :] if not end else "")
            kinds.append(TEXT if _LETTERS.search(plain(rest)) else CODE)
            continue
        if s.startswith("<!--") and "-->" not in s:
            comment = True
            kinds.append(TAG)
            continue
        if depth or s.startswith("{{") and s.count("{{") > s.count("}}"):
            depth = max(0, depth + s.count("{{") - s.count("}}"))
            kinds.append(TEMPLATE)
            continue
        if tag or c == "<" and "<" in s and s.rfind("<") > s.rfind(">") and re.match(r"<[A-Za-z][\w-]*(\s|$)", s) and i + 1 < len(lines) and ">" in "".join(lines[i + 1 : i + 4]):
            tag = ">" not in s
            rest = s.rpartition(">")[2] if not tag else ""
            kinds.append(TEXT if tag is False and _LETTERS.search(rest) else TAG)
            continue
        if s in ("$$", "\\[") or (m := _MATH_ENV.match(s)) and m[1] == "begin":
            kinds.append(FORMULA)
            maths = True
            continue
        if s.isdigit():
            kinds.append(CUE if i + 1 < len(lines) and "-->" in lines[i + 1] else NUMBER)
            continue
        if i + 1 < len(lines) and "-->" in lines[i + 1] and TIMING.match(lines[i + 1]):
            kinds.append(CUE)
            continue
        if "<" in s and "<!--" in s:
            s = _COMMENT.sub(" ", s)
        if s.startswith(("{|", "|-", "|}")) and not s.startswith("|---"):
            kinds.append(TAG)
            continue
        rest = plain(s)
        if _LETTERS.search(rest):
            kinds.append(TEXT)
        elif _LETTERS.search(s):
            kinds.append(TEMPLATE if "{{" in s else FORMULA if c in "$\\" and _FORMULA.search(s) else TAG if "<" in s or "\\" in s else NUMBER)
        else:
            kinds.append(NUMBER if any(x.isdigit() for x in s) else RULE)
    return kinds
