"""Problem 4: markup residue. HTML, Markdown, wiki text and LaTeX of any mixture become clean text that keeps headings,
lists, code blocks and formulas.

Method: tag-path ratios over the corpus. A document is read once into leaves, each with its root-to-leaf path (HTML
elements, LaTeX environments). Text length and punctuation are aggregated per path over all documents, and per section
(the path up to its last container, with all that lies below it); both are divided by the leaves there. A path seen seldom
leans on its last element, and that on the corpus (PRIOR leaves each). The two ratios are smoothed over the sequence of a
document's leaves with a Gaussian window in which leaves of other sections weigh little, and fused by their geometric mean.
Leaves whose fused ratio reaches THRESHOLD standard deviations of all paths' ratios are content, the others boilerplate.
Text is judged by its path; headings, list items and table cells, short by nature, by their section. Code and formulas
are content whatever their ratio; scripts, styles, comments and templates never are. What stands outside any element was
written plainly and always stays.

A structure is reported where a content leaf holds it, a family wherever its markup stands. Only numbers are shuffled: the
sums per path, and for documents with elements the ratios of their paths. Defined results: null gives null, empty and
blank texts stay as they are without traits; unclosed blocks run to the end; files delivered twice give equal rows, kept
once.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from math import exp, sqrt

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, map_rows, normal, spread, table

THRESHOLD = 0.5
WINDOW = 2
#: Weight of a neighbour in another section, against one in the same.
FOREIGN = 0.05
#: Leaves that the next wider statistic counts for in a path's ratio.
PRIOR = 2.0
#: Parts over which the paths that many documents share are spread.
SALTS = 16

# Elements that only wiki text has, and elements by role.
WIKI_TAGS = set("ref references nowiki syntaxhighlight source math chem gallery includeonly noinclude onlyinclude poem timeline hiero score templatestyles templatedata categorytree imagemap section inputbox pagequality".split())
HIDDEN = set("script style head title meta link template noscript iframe svg".split())
BLOCKS = set("html body main article section div p header footer nav aside blockquote table tbody thead tr td th form figure figcaption center dl dd dt".split())
ROWS = set("td th dt dd caption".split())
CONTAINERS = set("html body main article section div header footer nav aside form figure center blockquote".split())
LATEX_CODE = ("lstlisting", "verbatim", "verbatim*", "minted", "Verbatim")
LATEX_MATH = ("equation", "align", "gather", "displaymath", "math", "eqnarray", "multline")
LATEX_LIST = ("itemize", "enumerate", "description")
LATEX_HEAD = "part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title|frametitle"

_ANY = re.compile(r"[<&{}\[\]\\$*_`~#>|]|^=|^\s*(?:[-+]|\d{1,3}[.)])\s|^(?:=+|-{3,})\s*$", re.M)
_FENCE = re.compile(r"((?:> ?)*)[ ]{0,3}(`{3,}|~{3,})([^`\n]*)$")
_CODE_OPEN = re.compile(r"<(pre|syntaxhighlight|source|script|style)\b([^<>]*)>|\\begin\{(lstlisting|verbatim\*?|minted|Verbatim)\}(?:\[[^\]]*\])?(?:\{\w+\})?", re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)((?:\s[^<>]*)?)(/?)>")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_MATH_TAG = re.compile(r"<(math|chem)\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
_MATH = re.compile(r"\$\$(?P<a>[^$]+?)\$\$|\\\[(?P<b>.+?)\\\]|\\\((?P<c>.+?)\\\)|(?<![\\$A-Za-z0-9])\$(?P<d>(?=[^\s$])[^$\n]*?(?<=[^\s$\\]))\$(?![\d$])", re.S)
_MATHY = re.compile(r"[\\^_={}+<>]|^[A-Za-z](?:['′]|\s*[-*/,]\s*[A-Za-z0-9])*$")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?((?:\[[^\]\n]*\])?)\{")
_BARE = re.compile(r"\\(?:item|maketitle|tableofcontents|newpage|clearpage|noindent|centering|hline|LaTeX|TeX|ldots|dots|smallskip|medskip|bigskip|par|quad)(?![A-Za-z])")
_LATEX_HEAD = re.compile(rf"\\(?:{LATEX_HEAD})\*?(?:\[[^\]\n]*\])?\{{")
_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+)\*?\}")
_MD_HEAD = re.compile(r"(?:> ?)*[ ]{0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"[ ]{0,3}(=+|-{2,})[ \t]*$")
_WIKI_HEAD = re.compile(r"(={2,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
_RULE = re.compile(r"[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_QUOTE = re.compile(r"[ ]{0,3}(?:> ?)+")
_TASK = re.compile(r"\s*[-*+][ \t]+\[[ xX]\][ \t]+\S")
_DASH = re.compile(r"\s*[-+][ \t]+\S")
_NUMBER = re.compile(r"\s{0,3}(\d{1,9})[.)][ \t]+\S")
_STAR = re.compile(r"\s{0,12}\*[ \t]+\S")
_WIKI_ITEM = re.compile(r"(?:\*[^\s*]|[*#:;]{2,}[ \t]*[^\s*#:;]|#[^\s#\d!/-])")
_TABLE_RULE = re.compile(r"[ ]{0,3}\|?[ \t]*:?-{1,}:?[ \t]*(?:\|[ \t]*:?-{1,}:?[ \t]*)+\|?[ \t]*$")
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)|^\[[^\]\n]+\]:\s+\S+|!?\[([^\[\]\n]+)\]\[[^\]\n]+\]", re.M)
_STRONG = re.compile(r"(?<![*\\])(\*{2,3})(?=[^\s*])([^\n]*?[^\s*])\1(?!\*)|(?<![A-Za-z0-9_\\])(_{2,3})(?=[^\s_])([^\n]*?[^\s_])\3(?![A-Za-z0-9_])")
_EM = re.compile(r"(?<![*\\/])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![*/])|(?<![A-Za-z0-9_\\{/])_(?=[^\s_])([^_\n]*?[^\s_])_(?![A-Za-z0-9_}/])")
_DEL = re.compile(r"~~(?=[^\s~])([^~\n]*?[^\s~])~~")
_TICK = re.compile(r"(?<!`)(`+)(?!`)([^\n]*?[^`\n])\1(?!`)")
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n]+)\]\]|(?<![\[\w])\[(?:https?:|//)[^\s\]]+ [^\]\n]+\]")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_QUOTES = re.compile(r"'{2,5}(?=[^\s'])([^'\n]*?[^\s'])'{2,5}")
_WIKI_TABLE = re.compile(r"^\s*(?:\{\||\|\}|\|-)(?!-)", re.M)
_MAGIC = re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|^#REDIRECT\b", re.M)
_URL = re.compile(r"(?:https?|ftp)://[^\s<>()\[\]\"']+", re.A)
#: In Thai a blank stands where others write a comma or a stop.
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،]|(?<=[ก-๎]) (?=[ก-๎])")
_NO_LETTERS = re.compile(r"^[^\w]*$")

FAMILIES = ("html", "markdown", "wiki", "latex")


class Node:
    """A root-to-leaf path, by its elements' names. Children are made once, so a path costs nothing to write down."""

    __slots__ = ("parent", "name", "key", "section", "children", "sums")

    def __init__(self, parent: Node | None, name: str, container: bool):
        self.parent, self.name = parent, name
        self.key = xxhash.xxh64_intdigest(name, parent.key if parent else 0) >> 2
        self.section: Node = self if container or not parent else parent.section
        self.children: dict[str, Node] = {}
        self.sums = [0, 0, 0]  # leaves, characters, punctuation

    def child(self, name: str, container: bool) -> Node:
        if name not in self.children:
            self.children[name] = Node(self, name, container)
        return self.children[name]

    def within(self, name: str, top: Node) -> bool:
        """Whether an element of this name is open below top."""
        node = self
        while node is not top:
            if node.name == name:
                return True
            node = node.parent
        return False


class Leaf:
    __slots__ = ("path", "kind", "text", "formula")

    def __init__(self, path: Node, kind: str, text: str, formula: bool = False):
        self.path, self.kind, self.text, self.formula = path, kind, text, formula or kind == "formula"


def _entity(m: re.Match) -> bool:
    s = m[0]
    return s.startswith("&#") or s[1:] in html.entities.html5


class Reader:
    """Reads one document into leaves and traits."""

    def __init__(self, text: str):
        self.traits: set[str] = set()
        self.leaves: list[Leaf] = []
        self.root = self.at = Node(None, "", True)
        self.open: Counter[str] = Counter()
        self.stars: list[tuple[int, bool]] = []
        self.read(text)

    def up(self) -> str:
        """Closes the innermost element."""
        name = self.at.name
        self.open[name] -= 1
        self.at = self.at.parent
        return name

    def read(self, text: str) -> None:
        text = _COMMENT.sub(self._comment, text) if "<!--" in text and not re.search(r"```|~~~|<pre|\\begin\{(?:lst|verb)", text) else text
        lines = text.split("\n")
        n = len(lines)
        numbered = [bool(_NUMBER.match(_QUOTE.sub("", x, count=1))) for x in lines] if re.search(r"^[ >]*\d{1,9}[.)]\s", text, re.M) else None
        plain: list[str] = []  # lines that are read for inline markup together, so that tags may span lines
        i = 0
        while i < n:
            line = lines[i]
            m = _FENCE.match(line) if "```" in line or "~~~" in line else None
            if m:
                self.flush(plain)
                j = i + 1
                while j < n and not ((s := lines[j].lstrip("> ")).startswith(m[2]) and not s.strip().strip(m[2][0])):
                    j += 1
                self.traits |= {"markdown", "code"}
                self.leaves.append(Leaf(self.at.child("fence", False), "code", "\n".join(lines[i + 1 : j])))
                i = j + 1
                continue
            m = _CODE_OPEN.search(line) if "<" in line or "\\begin" in line else None
            if m and not (m[1] and m[2].rstrip().endswith("/")):
                name = (m[1] or m[3]).lower() if m[1] else m[3]
                end = re.compile(rf"</{name}\s*>" if m[1] else rf"\\end\{{{re.escape(name)}\}}", re.I)
                rest = line[m.end() :]
                body, after, j = [], "", i
                stop = end.search(rest)
                while not stop and j + 1 < n:
                    body.append(rest)
                    j += 1
                    rest = lines[j]
                    stop = end.search(rest)
                body.append(rest[: stop.start()] if stop else rest)
                after = rest[stop.end() :] if stop else ""
                if line[: m.start()].strip():
                    plain.append(line[: m.start()])
                self.flush(plain)
                code = "\n".join(body).strip("\n")
                if not m[1]:
                    self.traits |= {"latex", "code"}
                elif name in ("script", "style"):
                    self.traits.add("html")
                else:
                    self.traits |= {"wiki" if name in ("syntaxhighlight", "source") else "html", "code"}
                    if name == "pre":
                        code = html.unescape(re.sub(r"</?code\b[^<>]*>", "", code)).strip("\n")
                if name not in ("script", "style"):
                    self.leaves.append(Leaf(self.at.child(name, False), "code", code))
                if after.strip():
                    lines[j] = after
                    i = j
                else:
                    i = j + 1
                continue
            if numbered and numbered[i]:
                near = next((k for k in range(i - 1, -1, -1) if lines[k].strip()), None), next((k for k in range(i + 1, n) if lines[k].strip()), None)
                if any(k is not None and numbered[k] for k in near):
                    self.traits |= {"markdown", "list"}
                    line = "\ue001" + line
            plain.append(line)
            i += 1
        self.flush(plain)
        self._stars()

    def _comment(self, m: re.Match) -> str:
        self.traits.add("html")
        return "\n" * 0

    def flush(self, plain: list[str]) -> None:
        """Reads a run of lines outside code."""
        if not plain:
            return
        text = "\n".join(plain)
        plain.clear()
        if not _ANY.search(text) and "\ue001" not in text and "''" not in text:
            for line in text.split("\n"):
                self.leaves.append(Leaf(self.at, "text", line))
            return
        if "<!--" in text:
            text = _COMMENT.sub(self._comment, text)
        formulas: list[str] = []

        def keep(s: str) -> str:
            formulas.append(s.strip())
            return f"\ue000{len(formulas) - 1}\ue000"

        def tagged(m: re.Match) -> str:
            # Elements inside make it MathML, which is HTML; TeX inside is wiki text.
            self.traits |= {"html" if re.search(r"<m[a-z]+\b", m[2]) else "wiki", "formula"}
            return keep(re.sub(r"<[^<>]*>", " ", m[2]))

        def dollars(m: re.Match) -> str:
            body = m["a"] or m["b"] or m["c"] or m["d"]
            if m["d"] is not None and not _MATHY.search(m["d"]) or m["b"] is not None and not body.strip():
                return m[0]
            self.traits |= {"latex", "formula"}
            return keep(body)

        if "<math" in text or "<chem" in text:
            text = _MATH_TAG.sub(tagged, text)
        if "\\begin{" in text:
            for env in LATEX_MATH:
                if f"\\begin{{{env}" in text:

                    def whole(m: re.Match) -> str:
                        self.traits |= {"latex", "formula"}
                        return keep(m[1])

                    text = re.sub(rf"\\begin\{{{env}\*?\}}(.*?)(?:\\end\{{{env}\*?\}}|\Z)", whole, text, flags=re.S)
        if "$" in text or "\\[" in text or "\\(" in text:
            text = _MATH.sub(dollars, text)
        if "{{" in text:
            while True:
                text, k = _TEMPLATE.subn("\ue002", text)
                if not k:
                    break
                self.traits.add("wiki")
        if "&" in text and any(map(_entity, _ENTITY.finditer(text))):
            self.traits.add("html")
            text = _ENTITY.sub(lambda m: html.unescape(m[0]).replace("<", "\ue003").replace(">", "\ue004").replace("*", "\ue005").replace("_", "\ue006") if _entity(m) else m[0], text)
        self.blocks(text, formulas)

    def blocks(self, text: str, formulas: list[str]) -> None:
        """Line structure, element by element."""
        t = self.traits
        if _WIKI_TABLE.search(text) and ("{|" in text or "|}" in text):
            t.add("wiki")
        if _MAGIC.search(text):
            t.add("wiki")
        parts: list[tuple[Node, str, str]] = []  # (path, kind, text); a line may be cut by tags
        heading = ""
        pieces: list[str | re.Match] = []
        at = 0
        if "<" in text:
            for m in _TAG.finditer(text):
                pieces += [text[at : m.start()], m]
                at = m.end()
        pieces.append(text[at:])
        hidden = 0
        item = ""
        buffer = ""
        linked = False
        for p in pieces:
            if isinstance(p, str):
                if not hidden:
                    buffer += p
                linked = linked and not p
                continue
            close, name = bool(p[1]), p[2].lower()
            single = p[0].endswith("/>") or name in ("br", "hr", "img", "input", "meta", "link", "wbr", "col")
            if name in WIKI_TAGS and (name != "section" or re.match(r"\s+(?:begin|end)\s*=", p[3])):
                t.add("wiki")
                if name in ("ref", "gallery", "references"):
                    hidden = max(0, hidden + (-1 if close else 0 if single else 1))
                continue
            t.add("html")
            block = name in BLOCKS or name in ("ul", "ol", "li", "br", "hr", "caption") or len(name) == 2 and name[0] == "h" and name[1] in "123456"
            if not block:
                if name in HIDDEN:
                    hidden = max(0, hidden + (-1 if close else 0 if single else 1))
                elif name == "a" and not close and buffer and linked:
                    buffer += " "  # two links side by side are two words
                linked = name == "a" and close
                continue
            if buffer:
                parts.append((self.at, "heading" + heading if heading else "item" if item else "row" if self.at.name in ROWS else "text", buffer))
                buffer = ""
            if name == "br":
                parts.append((self.at, "text", "\n"))
            elif len(name) == 2 and name[0] == "h" and name[1] != "r":
                t.add("heading")
                heading = "" if close else name[1]
            elif name in ("ul", "ol", "li"):
                t.add("list")
                item = "" if close or name != "li" else name
            if close:
                if self.open[name]:
                    while self.up() != name:
                        pass
            elif not single:
                # A block ends an open paragraph, an item or a cell the one before it.
                if self.at.name == "p" or self.at.name == name and (name == "li" or name in ROWS):
                    self.up()
                self.at = self.at.child(name, name in CONTAINERS)
                self.open[name] += 1
        if buffer:
            parts.append((self.at, "heading" + heading if heading else "item" if item else "row" if self.at.name in ROWS else "text", buffer))
        for path, kind, chunk in parts:
            if kind == "text":
                self.lines(path, chunk, formulas)
            else:
                s = self.inline(" ".join(chunk.split()), formulas)
                if s:
                    level = int(kind[7:] or 1) if kind.startswith("heading") else 0
                    self.leaves.append(Leaf(path, "heading" if level else "row" if kind == "row" else "list", "#" * level + " " + s if level else s if kind == "row" else "- " + s, "\ue000" in chunk))

    def lines(self, path: Node, text: str, formulas: list[str]) -> None:
        t = self.traits
        lines = text.split("\n")
        where = path
        skip = False
        for i, raw in enumerate(lines):
            if skip:
                skip = False
                continue
            listed = raw.startswith("\ue001")
            line = raw[1:] if listed else raw
            s = line.strip()
            if not s:
                self.leaves.append(Leaf(path, "text", ""))
                continue
            formula = "\ue000" in s
            if "\\" in s:
                for m in _ENV.finditer(s):
                    t.add("latex")
                    if m[2] in LATEX_LIST:
                        t.add("list")
                    if m[1] == "begin":
                        where = where.child(m[2], m[2] not in LATEX_LIST)
                    elif where.within(m[2], path):
                        while where.name != m[2]:
                            where = where.parent
                        where = where.parent
                if _LATEX_HEAD.search(s):
                    t |= {"latex", "heading"}
                    self.leaves.append(Leaf(where, "heading", "# " + self.inline(re.sub(r"\\label\{[^{}]*\}", "", s), formulas), formula))
                    continue
                if _BARE.search(s) or _COMMAND.search(s):
                    t.add("latex")
                if re.match(r"\\item(?![A-Za-z])", s):
                    t |= {"latex", "list"}
                    self.leaves.append(Leaf(where, "list", "- " + self.inline(re.sub(r"^\\item\s*(?:\[[^\]]*\])?\s*", "", s), formulas), formula))
                    continue
            quoted = _QUOTE.match(line)
            if quoted and not s.startswith(">>>"):
                t.add("markdown")
                line = line[quoted.end() :]
                s = line.strip()
                if not s:
                    continue
            if (m := _WIKI_HEAD.match(s)) and not quoted:
                t |= {"wiki", "heading"}
                self.leaves.append(Leaf(where, "heading", "#" * len(m[1]) + " " + self.inline(m[2], formulas), formula))
                continue
            if m := _MD_HEAD.match(line):
                t |= {"markdown", "heading"}
                self.leaves.append(Leaf(where, "heading", m[1] + " " + self.inline(m[2], formulas), formula))
                continue
            if _RULE.match(line):
                t.add("markdown")
                continue
            after = lines[i + 1] if i + 1 < len(lines) else ""
            if (m := _SETEXT.match(after)) and not listed and not _TABLE_RULE.match(s) and not s.startswith("|") and (m[1][0] == "=" or len(m[1]) > 2 or len(m[1]) == 2):
                t |= {"markdown", "heading"}
                self.leaves.append(Leaf(where, "heading", ("# " if m[1][0] == "=" else "## ") + self.inline(s, formulas), formula))
                skip = True
                continue
            if "|" in s and _TABLE_RULE.match(s) and i and "|" in lines[i - 1]:
                t.add("markdown")
                continue
            if _TASK.match(line) or _DASH.match(line) or listed:
                t |= {"markdown", "list"}
                self.leaves.append(Leaf(where, "list", self.inline(line.rstrip(), formulas), formula))
                continue
            if line.startswith(("*", "#", ":", ";")) and _WIKI_ITEM.match(line) and not _STRONG.match(line) and not _EM.match(line):
                t |= {"wiki", "list"} if line[0] in "*#" or line[0] == ";" else set()
                self.stars.append((len(self.leaves), True))
                self.leaves.append(Leaf(where, "list", "- " + self.inline(line.lstrip("*#:; "), formulas), formula))
                continue
            if _STAR.match(line):
                t.add("list")
                self.stars.append((len(self.leaves), False))
                self.leaves.append(Leaf(where, "list", "- " + self.inline(line.lstrip(" \t*"), formulas), formula))
                continue
            if "wiki" in t and (s.startswith(("{|", "|-", "|}", "!", "|")) and not s.endswith("|")):
                if s.startswith(("{|", "|-", "|}")):
                    continue
                self.leaves.append(Leaf(where, "row", self.inline(re.sub(r"\s*(?:\|\||!!)\s*", " | ", s.lstrip("|! ")), formulas), formula))
                continue
            out = self.inline(line, formulas)
            if out.strip() or not s:
                kind = "formula" if "\ue000" in s and not re.sub("\ue000\\d+\ue000", "", s).strip() else "row" if s.startswith("|") and s.endswith("|") else "text"
                self.leaves.append(Leaf(where, kind, out, formula))

    def inline(self, s: str, formulas: list[str]) -> str:
        """One line without inline markup."""
        t = self.traits
        if "`" in s:
            s, k = _TICK.subn(lambda m: m[2].replace("*", "\ue005").replace("_", "\ue006"), s)
            if k:
                t.add("markdown")
        if "[[" in s or "[http" in s or "[//" in s:
            s, k = _WIKI_LINK.subn(lambda m: (m[1] or m[0][1:-1].partition(" ")[2]).rpartition("|")[2], s)
            if k:
                t.add("wiki")
        if "[" in s:
            s, k = _LINK.subn(lambda m: m[1] or m[2] or "", s)
            if k:
                t.add("markdown")
        held: list[str] = []
        if "://" in s:

            def hold(m: re.Match) -> str:
                held.append(m[0])
                return f"\ue007{len(held) - 1}\ue007"

            s = _URL.sub(hold, s)
        if "\\" in s:
            while True:
                s, k = re.subn(r"\\(cite|ref|label|eqref|pageref|index|vspace|hspace|includegraphics|usepackage|documentclass|begin|end|bibliography|input)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}(?:\[[^\]\n]*\])?", self._latex, s)
                s, j = re.subn(r"\\footnote\{([^{}]*)\}", self._note, s)
                s, h = re.subn(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", self._argument, s)
                if not (k or j or h):
                    break
            if "latex" in t:
                s = _BARE.sub("", re.sub(r"\\([%&_#$])", r"\1", s)).replace("~", " ")
        for p in (_STRONG, _EM, _DEL):
            if "*" in s or "_" in s or "~" in s:
                s, k = p.subn(lambda m: next((g for g in m.groups()[::-1] if g and g.strip("*_~")), ""), s)
                if k:
                    t.add("markdown")
        if "''" in s:
            s, k = _QUOTES.subn(r"\1", s)
            if k:
                t.add("wiki")
        if "\ue007" in s:
            s = re.sub("\ue007(\\d+)\ue007", lambda m: held[int(m[1])], s)
        if "\ue000" in s:
            s = re.sub("\ue000(\\d+)\ue000", lambda m: f"${formulas[int(m[1])]}$", s)
        return s.replace("\ue001", "").replace("\ue002", "").replace("\ue003", "<").replace("\ue004", ">").replace("\ue005", "*").replace("\ue006", "_")

    def _latex(self, m: re.Match) -> str:
        self.traits.add("latex")
        return ""

    def _note(self, m: re.Match) -> str:
        self.traits.add("latex")
        return f" ({m[1]})"

    def _argument(self, m: re.Match) -> str:
        self.traits.add("latex")
        return m[1]

    def _stars(self) -> None:
        """Items with one star and a blank are Markdown or wiki text, as their neighbours and the rest of the text say."""
        if not any(not w for _, w in self.stars):
            return
        sure = {i for i, w in self.stars if w}
        wiki = "wiki" in self.traits
        every = sorted(i for i, _ in self.stars)
        run: list[int] = []
        for i in [*every, -9]:
            if run and i != run[-1] + 1:
                self.traits.add("wiki" if sure & set(run) or wiki and "markdown" not in self.traits else "markdown")
                run = []
            run.append(i)


STRUCTURES = ("heading", "list", "code", "formula")
_GAUSS = [exp(-(k * k) / 2) for k in range(-WINDOW, WINDOW + 1)]


class Reading:
    """One document's leaves as numbers, what it adds to the paths' sums, and the traits that were read."""

    def __init__(self, text: str | None):
        self.traits: list[str] = []
        self.keys: list[int] = []  # of each leaf, the path that judges it; 0 if it stays anyway
        self.sections: list[int] = []
        self.marks: list[int] = []  # bits of STRUCTURES
        self.texts: list[str] = []
        self.sums: list[tuple[int, int, int, int, int]] = []  # path, its last element, leaves, characters, punctuation
        self.whole: str | None = text
        if text is None:
            return
        text = self.whole = normal(text)
        if not _ANY.search(text) and "''" not in text:
            return
        reader = Reader(text)
        self.whole = None if reader.leaves else ""
        self.traits = sorted(reader.traits)
        nodes: list[Node] = []
        queue = [reader.root]
        for node in queue:  # parents stand before their children
            nodes.append(node)
            queue += node.children.values()
        own = {id(n): [0, 0, 0] for n in nodes}
        for x in reader.leaves:
            judge = x.path if x.kind == "text" else x.path.section
            judged = judge is not reader.root and x.text.strip() and x.kind not in ("code", "formula")
            # A section's key is its path's, turned, so that the two sums stay apart.
            self.keys.append(0 if not judged else judge.key if x.kind == "text" else ~judge.key)
            self.sections.append(x.path.section.key)
            self.marks.append(sum(1 << i for i, s in enumerate(STRUCTURES) if x.kind == s or s == "formula" and x.formula))
            self.texts.append(f"```\n{x.text}\n```" if x.kind == "code" else x.text.rstrip())
            if x.text.strip():
                marks = len(_PUNCTUATION.findall(x.text))
                for sums in (own[id(x.path)] if x.kind == "text" else None, x.path.section.sums):
                    if sums is not None:
                        sums[0] += 1
                        sums[1] += len(x.text)
                        sums[2] += marks
        for node in reversed(nodes):
            if node.parent and node.section is node:
                up = node.parent.section.sums
                for i in range(3):
                    up[i] += node.sums[i]
        for node in nodes[1:]:
            element = xxhash.xxh64_intdigest(node.name, 1) >> 2
            if own[id(node)][0]:
                self.sums.append((node.key, element, *own[id(node)]))
            if node.section is node and node.sums[0]:
                self.sums.append((~node.key, ~element, *node.sums))

    def kept(self, ratios: dict[int, tuple[float, float]], threshold: float) -> list[bool]:
        """Whether each leaf is content. ratios: (length, punctuation) by path."""
        n = len(self.keys)
        out = [True] * n
        for i, key in enumerate(self.keys):
            if key and key in ratios:
                a = b = w = 0.0
                for j in range(max(0, i - WINDOW), min(n, i + WINDOW + 1)):
                    if self.keys[j] in ratios:
                        g = _GAUSS[j - i + WINDOW] * (1.0 if self.sections[j] == self.sections[i] else FOREIGN)
                        length, marks = ratios[self.keys[j]]
                        a, b, w = a + g * length, b + g * marks, w + g
                out[i] = sqrt(a * b) / w >= threshold
        return out

    def found(self, kept: list[bool]) -> list[str]:
        """The traits: a structure that is written in leaves must be written in one that is kept."""
        written = alive = 0
        for m, k in zip(self.marks, kept):
            written |= m
            alive |= m * k
        return [t for t in self.traits if t not in STRUCTURES or not written >> STRUCTURES.index(t) & 1 or alive >> STRUCTURES.index(t) & 1]

    def clean(self, kept: list[bool]) -> str | None:
        if not self.keys:
            return self.whole
        out: list[str] = []
        for text, k in zip(self.texts, kept):
            if k and (text.strip() or out and out[-1].strip()):
                out.append(text)
        return "\n".join(out).strip("\n")


def ratios(sums: list[tuple[int, int, int, int, int]], threshold: float = THRESHOLD) -> tuple[dict[int, tuple[float, float]], float]:
    """(ratios by path, threshold) of sums over one or more documents: what `path_ratios` does on tables, for small ones."""
    total: dict[tuple[int, int], list[float]] = {}
    for key, element, *x in sums:
        own = total.setdefault((key, element), [0.0, 0.0, 0.0])
        for i in range(3):
            own[i] += x[i]
    wide: dict[int, list[float]] = {}
    every = [0.0, 0.0, 0.0]
    for (_, element), x in total.items():
        for at in (wide.setdefault(element, [0.0, 0.0, 0.0]), every):
            for i in range(3):
                at[i] += x[i]
    out, f1, f2 = {}, 0.0, 0.0
    for (key, element), (n, *x) in total.items():
        ratio = []
        for i in (0, 1):
            base = (wide[element][i + 1] + PRIOR * every[i + 1] / every[0]) / (wide[element][0] + PRIOR)
            ratio.append((x[i] + PRIOR * base) / (n + PRIOR))
        out[key] = (ratio[0], ratio[1])
        f = sqrt(ratio[0] * ratio[1])
        f1, f2 = f1 + n * f, f2 + n * f * f
    n = every[0] or 1.0
    return out, threshold * sqrt(max(0.0, f2 / n - (f1 / n) ** 2))


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, traits) of one document, judged by its own paths alone."""
    r = Reading(text)
    kept = r.kept(*ratios(r.sums))
    return r.clean(kept), r.found(kept)


_READ = pa.schema(
    [("row", pa.int64()), ("file_id", pa.int64()), ("traits", pa.list_(pa.string())), ("keys", pa.list_(pa.int64())), ("sections", pa.list_(pa.int64())), ("marks", pa.list_(pa.int32())), ("texts", pa.list_(pa.string())), ("whole", pa.string())]
    + [(c, pa.list_(pa.int64())) for c in ("paths", "elements", "leaves", "characters", "punctuation")]
)
_READ_DDL = "row long, file_id long, traits array<string>, keys array<long>, sections array<long>, marks array<int>, texts array<string>, whole string, paths array<long>, elements array<long>, leaves array<long>, characters array<long>, punctuation array<long>"


def readings(df: DataFrame, key: str, text: str, with_text: bool) -> DataFrame:
    """Every row's document read, as numbers, with the texts of its leaves only if they are wanted."""

    def each(row, k, t):
        r = Reading(t)
        sums = list(zip(*r.sums)) or [()] * 5
        return [(row, k, r.traits, r.keys, r.sections, r.marks, r.texts if with_text else None, r.whole if with_text else None, *map(list, sums))]

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("file_id"), F.col(text).alias("content"))
    return map_rows(rows, ["row", "file_id", "content"], each, _READ, _READ_DDL)


def path_ratios(read: DataFrame) -> DataFrame:
    """(path, length, punctuation, n) for every path of all documents."""
    sums = read.select(F.explode(F.arrays_zip("paths", "elements", "leaves", "characters", "punctuation")).alias("z")).select("z.*")
    total = sums.groupBy("paths", "elements").agg(F.sum("leaves").alias("n"), F.sum("characters").alias("c"), F.sum("punctuation").alias("p"))
    wide = total.groupBy("elements").agg(F.sum("n").alias("wn"), F.sum("c").alias("wc"), F.sum("p").alias("wp"))
    every = wide.agg(F.sum("wn").alias("n"), F.sum("wc").alias("c"), F.sum("wp").alias("p")).first()
    joined = total.join(wide, "elements")

    def ratio(own: str, wider: str, mean: float):
        return (F.col(own) + PRIOR * (F.col(wider) + PRIOR * mean) / (F.col("wn") + PRIOR)) / (F.col("n") + PRIOR)

    n = every.n or 1
    return joined.select(F.col("paths").alias("path"), ratio("c", "wc", (every.c or 0) / n).alias("length"), ratio("p", "wp", (every.p or 0) / n).alias("punctuation"), "n")


def selected(read: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, traits, clean_text, dropped): what is left of every document, and how many leaves are not. read is read
    several times: give it checkpointed."""
    by_path = path_ratios(read)
    fused = F.sqrt(F.col("length") * F.col("punctuation"))
    s = by_path.agg(F.sum("n").alias("n"), F.sum(F.col("n") * fused).alias("f"), F.sum(F.col("n") * fused * fused).alias("ff")).first()
    limit = threshold * sqrt(max(0.0, s.ff / s.n - (s.f / s.n) ** 2)) if s.n else 0.0
    # A path that a third of all documents share is spread over SALTS parts.
    wanted = read.where("size(paths) > 0").select("row", F.explode(F.array_distinct("keys")).alias("path")).where("path <> 0").withColumn("salt", F.pmod("row", F.lit(SALTS)))
    salted = by_path.select("path", "length", "punctuation").withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    known = wanted.join(salted, ["path", "salt"]).groupBy("row").agg(F.collect_list(F.struct("path", "length", "punctuation")).alias("known"))

    def each(file_id, traits, keys, sections, marks, texts, whole, known):
        r = Reading(None)
        r.traits, r.keys, r.sections, r.marks, r.texts, r.whole = traits, keys, sections, marks, texts or [], whole
        kept = r.kept({x["path"]: (x["length"], x["punctuation"]) for x in known or ()}, limit)
        return [(file_id, r.found(kept), r.clean(kept) if texts is not None else None, kept.count(False))]

    columns = ["file_id", "traits", "keys", "sections", "marks", "texts", "whole"]
    judged = read.where("size(paths) > 0").join(known, "row", "left").select(*columns, "known")
    plain = read.where("size(paths) = 0").select(*columns, F.lit(None).cast("array<struct<path: long, length: double, punctuation: double>>").alias("known"))
    return map_rows(plain.unionByName(judged), [*columns, "known"], each, _CLEAN, "file_id long, traits array<string>, clean_text string, dropped long")


_CLEAN = pa.schema([("file_id", pa.int64()), ("traits", pa.list_(pa.string())), ("clean_text", pa.string()), ("dropped", pa.int64())])


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text and traits of every file."""
    files = table(spark, sf_dir, "files").select("file_id", "content").distinct()
    return selected(checkpointed(readings(files, "file_id", "content", True))).drop("dropped")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families and structures of markup in each file."""
    files = spread(table(spark, sf_dir, "files").select("file_id", "content"))
    found = selected(checkpointed(readings(files, "file_id", "content", False)))
    return found.select("file_id", F.explode("traits").alias("trait")).distinct()
