"""Markup residue in Markdown: found, and turned into clean Markdown.

A text is read as a sequence of words and markup tokens; code blocks, inline code and formulas between dollar signs are
kept apart and never looked into. Words score positive, markup tokens negative; a linear scan counts the negative ones,
which tell whether the text holds markup, and finds the contiguous region with the highest score, which is the content.
What lies outside of it at the text's ends is left out line by line as long as a line is no prose (bare navigation,
dangling tags), and is reported. Inside headings, lists, tables, code and formulas are kept, in Markdown.
What only resembles markup stays: placeholders to be filled in, comparisons, inch marks, paths, prices.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element names of HTML.
HTML_TAGS = frozenset(
    "a abbr address article aside audio b blockquote body br button caption center cite code col colgroup dd del details div dl dt em embed fieldset figcaption figure "
    "font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav nobr noscript object ol optgroup option p "
    "param pre q ref s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul "
    "var video wbr frame frameset big references gallery nowiki math".split()
)
#: LaTeX commands that stand without an argument.
BARE_COMMANDS = "item maketitle tableofcontents newline newpage noindent centering ldots dots hfill vfill par linebreak pagebreak clearpage bigskip medskip smallskip quad qquad LaTeX TeX alpha beta gamma delta lambda mu pi sigma omega cdot times pm leq geq le ge degree"

#: Scores of a word, of a furniture token (navigation, forms, scripts), of a tag of a link, and of any other markup token. The
#: latter three were chosen by fit() on labelled_pages() of the first 80 texts of job_result at scale 0.01.
WORD_SCORE = 1.0
TOKEN_SCORE, LINK_SCORE, LIGHT_SCORE = -3.5, -1.5, -0.5
#: A line with so many words is prose and is never left out, unless it stands in a script or the like; words of links with fewer don't count.
PROSE_WORDS = 4
FURNITURE = frozenset("nav script style header footer form input button select option iframe link meta head noscript aside".split())

PROTECTED = re.compile(
    r"(?P<fence>^[ ]{0,3}(?P<ticks>`{3,}|~{3,})[^\n]*\n(?:.*?^[ ]{0,3}(?P=ticks)[`~]*[ \t]*$|.*\Z))"
    r"|(?P<block>(?:(?<=\n\n)|\A)(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+)"
    r"|(?P<inline>(?P<tick>`+)(?!`)(?:[^\n]|\n(?!\s*\n))+?(?<!`)(?P=tick)(?!`))"
    r"|(?P<display>\$\$(?:[^\n]|\n(?!\s*\n))+?\$\$)"
    r"|(?P<math>(?<![\\\w$])\$(?=[^\s$])(?:[^$\n]*[\\^_{}=+][^$\n]*|[A-Za-z])(?<=\S)\$(?!\d))",
    re.S | re.M,
)
TOKEN = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z)|<![A-Za-z][^>\n]*>)"
    r"|(?P<tag></?(?P<name>[A-Za-z][A-Za-z0-9]*)(?P<attributes>(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))*|\s+(?:disabled|checked|selected|hidden|nowrap|noshade))\s*/?>)"
    r"|(?P<entity>&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)"
    r"|(?P<link>\[\[[^\[\]\n]+\]\])"
    r"|(?P<template>\{\{[^{}\n]*[|:][^{}]*\}\}|\{\{[A-Z#][^{}\n]*\}\})"
    r"|(?P<wikitable>^\{\|.*?(?:^\|\}|\Z))"
    r"|(?P<wikihead>^(?P<level>={1,6})[ \t]*[^=\n]+?[ \t]*(?P=level)[ \t]*$)"
    r"|(?P<bold>'''(?P<strong>[^'\n]+(?:'[^'\n]+)*)''')"
    r"|(?P<italic>(?<![\d'])''(?=[^\s'\d])(?P<slanted>[^'\n]+(?:'[^'\n]+)*)(?<![\s\d])''(?!'))"
    r"|(?P<switch>__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__)"
    r"|(?P<command>(?<!\\)\\(?P<verb>[A-Za-z]+)\*?(?=[\[{])|(?<![\w\\:./])\\(?P<bare>" + "|".join(BARE_COMMANDS.split()) + r")\b)",
    re.S | re.M,
)
QUICK = re.compile(r"[<&\\]|\[\[|\{\{|''|^\{\||^=|__", re.M)
WORD = re.compile(r"\w+")
PATH = re.compile(r"(?:[A-Za-z]:|\\)\\[\w .-]*$")


class Token:
    __slots__ = ("start", "stop", "kind", "match")

    def __init__(self, match: re.Match):
        self.start, self.stop, self.kind, self.match = match.start(), match.end(), match.lastgroup, match
        for kind in ("comment", "tag", "entity", "link", "template", "wikitable", "wikihead", "bold", "italic", "switch", "command"):
            if match.group(kind) is not None:
                self.kind = kind


def is_markup(match: re.Match) -> bool:
    name = match.group("name")
    if name is not None:
        return name.lower() in HTML_TAGS
    if match.group("entity") is not None:
        return html.unescape(match.group()) != match.group()
    if match.group("command") is not None:
        return not PATH.search(match.string[max(0, match.start() - 60) : match.start() + 1].rsplit("\n", 1)[-1])
    return True


def protected(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PROTECTED.finditer(text)] if "`" in text or "$" in text or "~~~" in text or "    " in text or "\t" in text else []


def tokens(text: str) -> list[Token]:
    """Markup tokens of a text, in order, outside of code and formulas."""
    if not QUICK.search(text):
        return []
    out, spans = [], [*protected(text), (len(text), len(text))]
    masked = list(text) if len(spans) > 1 else text
    if len(spans) > 1:
        for a, b in spans[:-1]:
            masked[a:b] = ["\n" if c == "\n" else "¤" for c in text[a:b]]
        masked = "".join(masked)
    for m in TOKEN.finditer(masked):
        if is_markup(m):
            out.append(Token(m))
    return out


def kind_of_token(token: Token) -> int:
    """1: furniture of a page, 2: a tag of a link, 3: other markup."""
    name = token.match.group("name") if token.kind == "tag" else None
    return 1 if name and name.lower() in FURNITURE else 2 if name and name.lower() == "a" else 3


def events(text: str, marks: list[Token]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the words (kind 0) and markup tokens of a text, in order; words within a tag or the like aren't counted."""
    out, i = [], 0
    for m in WORD.finditer(text):
        while i < len(marks) and marks[i].start <= m.start():
            out.append((marks[i].start, marks[i].stop, kind_of_token(marks[i])))
            i += 1
        if not (i and marks[i - 1].stop >= m.end() and marks[i - 1].kind in ("comment", "tag", "entity", "command", "switch")):
            out.append((m.start(), m.end(), 0))
    return out + [(t.start, t.stop, kind_of_token(t)) for t in marks[i:]]


def scan(sequence: list[tuple[int, int, int]], scores: tuple[float, float, float, float]) -> tuple[int, int, int]:
    """(start, end, negatives): the contiguous run of words and tokens with the highest sum of scores, by kind, and how many scored below 0."""
    best, span, total, start, negatives = 0.0, (0, 0), 0.0, 0, 0
    for a, b, kind in sequence:
        if total <= 0:
            total, start = 0.0, a
        total += scores[kind]
        negatives += scores[kind] < 0
        if total >= best:
            best, span = total, (start, b)
    return (*(span if best > 0 else (0, 0)), negatives)


SCORES = (WORD_SCORE, TOKEN_SCORE, LINK_SCORE, LIGHT_SCORE)
#: Elements whose text nobody reads.
SENTENCE = re.compile(r"(?<=\w)[.!?:][\"')\]]*(?:[ \t]*</?[A-Za-z][^<>\n]*>)*[ \t]*(?:\n|\Z)")
LINKED = re.compile(r"<a\b[^<>]*>(.*?)</a\s*>", re.S | re.I)
UNREAD = re.compile(r"<(script|style|nav|head|form|select)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)


def line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def region(text: str, marks: list[Token], scores: tuple[float, float, float, float] = SCORES) -> tuple[int, int, int]:
    """(start, end, markup tokens): the region of highest score in whole lines, widened over all lines that are prose."""
    sequence = events(text, marks)
    start, end, negatives = scan(sequence, scores)
    start, end = (text.rfind("\n", 0, start) + 1, line_end(text, end)) if end else (len(text), len(text))
    if start or end < len(text):
        short = [m.span() for m in LINKED.finditer(text) if len(WORD.findall(m.group(1))) < PROSE_WORDS]
        unread = [m.span() for m in UNREAD.finditer(text)] + short
        covered = bytearray(len(text))
        for x, y in unread:
            covered[x:y] = b"\1" * (y - x)
        words = [a for a, b, kind in sequence if not kind and (a < start or b > end) and not covered[a]]
        for i, j in protected(text):  # code and formulas are content wherever they stand
            start, end = min(start, text.rfind("\n", 0, i) + 1), max(end, j)
        lines: dict[int, int] = {}
        for a in words:
            at = text.rfind("\n", 0, a) + 1
            lines[at] = lines.get(at, 0) + 1
        prose = [at for at, n in lines.items() if n >= PROSE_WORDS or text.startswith(("#", "|"), at) or SENTENCE.search(text, at, line_end(text, at))]
        if prose:
            start, end = min(start, min(prose)), max(end, line_end(text, max(prose)))
    return start, end, negatives


MENUS = ["Home", "News", "Contact", "Log in", "Sitemap", "All topics", "Products", "About us", "Next page", "Print", "Terms", "Search", "Up", "Imprint"]


def labelled_pages(texts: list[str], seed: int = 3) -> list[tuple[str, str]]:
    """(page, content): texts with navigation around them; every third has a list of linked titles at its end, which is content."""
    rng = random.Random(seed)

    def menu() -> str:
        items = [f'<li><a href="/{k}">{x}</a></li>' for k, x in enumerate(rng.sample(MENUS, rng.randint(3, 8)))]
        kind = rng.randrange(4)
        inner = "\n".join(items) if kind < 2 else " | ".join(re.sub(r"</?li>", "", x) for x in items)
        return f"<ul>\n{inner}\n</ul>" if kind == 0 else f"<nav>\n<ul>\n{inner}\n</ul>\n</nav>" if kind == 1 else f"<div>{inner}</div>" if kind == 2 else f"<footer>{inner}</footer>"

    pages = []
    for i, text in enumerate(texts):
        content = text.strip()
        if i % 3 == 0:
            words = WORD.findall(content)[:60]
            content += "\n\n" + "\n".join(f'<li><a href="/doc{k}">{" ".join(words[4 * k : 4 * k + rng.randint(4, 8)])}</a></li>' for k in range(1, rng.randint(3, 11)) if 4 * k + 4 <= len(words))
        pages.append((f"{menu()}\n\n{content}\n\n{menu()}" if i % 2 else f"{content}\n\n{menu()}", content))
    return pages


def fit(pages: list[tuple[str, str]]) -> tuple[float, float, float]:
    """The scores of furniture, links and other tokens with which the regions of labelled pages come nearest to their content; content lost counts ten times."""
    known = []
    for text, content in pages:
        at = text.index(content)
        known.append((text, events(text, tokens(text)), at, at + len(content)))

    def loss(scores: tuple[float, float, float, float]) -> int:
        total = 0
        for text, sequence, at, end in known:
            a, b, _ = scan(sequence, scores)
            a, b = text.rfind("\n", 0, a) + 1, text.find("\n", b) % (len(text) + 1)
            total += 10 * (max(a - at, 0) + max(end - b, 0)) + max(at - a, 0) + max(b - end, 0)
        return total

    grid = [(x, y, z) for x in (-0.5 * k for k in range(1, 13)) for y in (-0.25 * k for k in range(1, 13)) for z in (-0.05, -0.1, -0.25, -0.5, -1.0)]
    losses = [loss((WORD_SCORE, *g)) for g in grid]
    best = [g for g, v in zip(grid, losses) if v == min(losses)]
    return best[len(best) // 2]


def cell(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().replace("|", "\\|")


def pipe_table(rows: list[list[str]]) -> str:
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n\n" + "\n".join([lines[0], "|" + "---|" * width, *lines[1:]]) + "\n\n"


def paired(text: str, name: str, make) -> str:
    """Each element of a name, from its tag to the next closing one, as `make` gives it from (attributes, content).

    Only the text up to the last closing tag is searched, so that tags that are never closed cost nothing.
    """
    end = max((m.end() for m in re.finditer(rf"</{name}\s*>", text, re.I)), default=0)
    if not end:
        return text
    return re.sub(rf"<{name}\b([^<>]*)>(.*?)</{name}\s*>", lambda m: make(m.group(1), m.group(2)), text[:end], flags=re.S | re.I) + text[end:]


def html_tables(text: str) -> str:
    def table(_: str, inner: str) -> str:
        rows = re.split(r"<tr\b[^<>]*>", inner, flags=re.I)[1:]
        cells = [re.split(r"<t[dh]\b[^<>]*>", re.sub(r"</tr\s*>.*", "", r, flags=re.S | re.I), flags=re.I)[1:] for r in rows]
        return pipe_table([[cell(re.sub(r"<[^<>]*>", "", c)) for c in r] for r in cells])

    return paired(text, "table", table)


def wiki_table(text: str) -> str:
    rows: list[list[str]] = [[]]
    for line in text.split("\n")[1:]:
        line = line.strip()
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith(("|}", "|+")):
            continue
        elif line.startswith(("|", "!")):
            rows[-1] += [cell(c.rsplit("|", 1)[-1]) for c in re.split(r"\|\||!!", line[1:])]
    return pipe_table(rows)


def latex(text: str) -> str:
    level = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
    text = re.sub(r"\\(part|chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}]*)\}[ \t]*", lambda m: f"\n\n{'#' * level[m.group(1)]} {m.group(2).strip()}\n\n", text)
    kinds: list[str] = []

    def environment(m: re.Match) -> str:
        if m.group(1) == "begin":
            kinds.append(m.group(2))
            return "\n\n" if m.group(2) in ("itemize", "enumerate", "description") else "\n"
        if m.group(1) == "end":
            if kinds:
                kinds.pop()
            return "\n"
        return "1. " if kinds and kinds[-1] == "enumerate" else "- "

    text = re.sub(r"\\(begin|end)\{(\w+)\*?\}(?:\[[^\]]*\])?|\\item\b(?:\[[^\]]*\])?[ \t]*", lambda m: environment(m) if m.group(1) else environment(re.match(r"(item)()", "item")), text)
    for _ in range(3):
        text = re.sub(r"\\(?:textbf|bf|strong)\{([^{}]*)\}", r"**\1**", text)
        text = re.sub(r"\\(?:emph|textit|it|underline)\{([^{}]*)\}", r"*\1*", text)
        text = re.sub(r"\\(?:texttt|verb)\{([^{}]*)\}", r"`\1`", text)
        text = re.sub(r"\\(?:label|hspace|vspace|cite[a-z]*|index|pagestyle|thispagestyle|includegraphics)\*?(?:\[[^\]]*\])*\{[^{}]*\}[ \t]?", "", text)
        text = re.sub(r"\s*\\footnote\{([^{}]*)\}", r" (\1)", text)
        text = re.sub(r"\\(?:ref|eqref|url|href|caption|title|author|text[a-z]*|mbox)\*?(?:\[[^\]]*\])*\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\(?:maketitle|tableofcontents|noindent|centering|newpage|clearpage|hfill|vfill|bigskip|medskip|smallskip)\b[ \t]?", "", text)
    text = re.sub(r"\\(?:ldots|dots)\b", "...", text)
    text = re.sub(r"(?<![\\\w])\\\\(?:\[[^\]]*\])?[ \t]*|(?<=\w)\\\\(?=\s)|\\(?:newline|par|linebreak)\b", "\n", text)
    return re.sub(r"(?<=\w)~(?=[\w\s(]|$)", " ", text)


def convert_html(text: str) -> str:
    text = re.sub(r"<!--.*?(?:-->|\Z)|<![A-Za-z][^>\n]*>", "", text, flags=re.S)
    for name in ("script", "style", "head"):
        text = paired(text, name, lambda _, inner: "")
    text = html_tables(text)
    text = paired(text, "pre", lambda _, inner: "\n\n```\n" + re.sub(r"</?code[^<>]*>", "", inner).strip("\n") + "\n```\n\n")
    for level in range(1, 7):
        text = paired(text, f"h{level}", lambda _, inner, mark="#" * level: f"\n\n{mark} {inner.strip()}\n\n")

    def link(attributes: str, inner: str) -> str:
        to = re.search(r"href\s*=\s*[\"']?([^\"'\s>]+)", attributes, re.I)
        return f"[{inner}]({to.group(1)})" if to and not to.group(1).startswith("#") else inner

    def image(m: re.Match) -> str:
        found = [re.search(k + r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))", m.group(1), re.I) for k in ("alt", "src")]
        alt, src = (next((g for g in f.groups() if g is not None), "") if f else "" for f in found)
        return f"![{alt}]({src})"

    text = paired(text, "a", link)
    text = re.sub(r"<img\b([^<>]*)>", image, text, flags=re.I)
    for name, mark in (("b", "**"), ("strong", "**"), ("i", "*"), ("em", "*"), ("code", "`"), ("tt", "`"), ("kbd", "`"), ("samp", "`"), ("s", "~~"), ("strike", "~~"), ("del", "~~")):
        text = paired(text, name, lambda _, inner, mark=mark: f"{mark}{inner}{mark}")
    text = paired(text, "ol", lambda _, inner: "\n" + re.sub(r"<li\b[^<>]*>\s*", "\n1. ", inner, flags=re.I) + "\n\n")
    text = re.sub(r"\s?<li\b[^<>]*>\s*", "\n- ", text, flags=re.I)
    text = re.sub(r"<br\s*/?>", "\n", text, flags=re.I)
    text = re.sub(r"<hr\b[^<>]*>", "\n\n---\n\n", text, flags=re.I)
    text = re.sub(r"</?(?:p|div|ul|ol|section|article|blockquote|table|tr|dl|header|footer|center|main|nav)\b[^<>]*>", "\n\n", text, flags=re.I)
    text = TOKEN.sub(lambda m: "" if m.group("tag") and is_markup(m) else m.group(), text)
    return re.sub(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", lambda m: html.unescape(m.group()).replace("\xa0", " "), text)


def convert_wiki(text: str) -> str:
    text = re.sub(r"^\{\|.*?(?:^\|\}|\Z)", lambda m: wiki_table(m.group()), text, flags=re.S | re.M)
    text = re.sub(r"^(={1,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", lambda m: f"{'#' * len(m.group(1))} {m.group(2)}\n", text, flags=re.M)
    text = re.sub(r"\[\[(?:File|Image|Category|Datei|Fichier|Archivo):[^\]\n]*\]\] ?", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", text)
    text = TOKEN.sub(lambda m: "" if m.group("template") or m.group("switch") else f"**{m.group('strong')}**" if m.group("bold") else f"*{m.group('slanted')}*" if m.group("italic") else m.group(), text)
    return text


class Cleaned(NamedTuple):
    text: str
    n_markup: int
    cut: str | None


def clean(text: str) -> Cleaned:
    """Clean Markdown of a text's content region, the number of markup tokens in the text, and what was left out. A text without any is left as it is."""
    marks = tokens(text)
    if not marks:
        return Cleaned(text, 0, None)
    a, b, n_markup = region(text, marks)
    body = text[a:b]
    cut = "\n".join(x for x in (text[:a].strip("\n"), text[b:].strip("\n")) if x.strip()) or None
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m.group())
        return f"\ue000{len(kept) - 1}\ue001"

    body = PROTECTED.sub(keep, body)
    kinds = {t.kind for t in marks}
    if kinds & {"command"}:
        body = latex(body)
    if kinds & {"link", "template", "wikitable", "wikihead", "bold", "italic", "switch"}:
        body = convert_wiki(body)
    if kinds & {"comment", "tag", "entity"}:
        body = convert_html(body)
    body = re.sub(r"[ \t]+\n", "\n", body)
    body = re.sub(r"\n{3,}", "\n\n", body).strip("\n")
    return Cleaned(re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))], body), n_markup, cut)


def cleaned(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, `text` as clean Markdown, `n_markup`, the number of markup tokens found, and `cut`, the lines left out at its ends.

    Null texts stay null with no tokens, empty ones empty. Repeated rows each give a row; there is no shuffle.
    """
    schema = texts.select(*keys).schema.add("text", "string").add("n_markup", "integer").add("cut", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(None, 0, None) if t is None else clean(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({**{k: batch.column(k) for k in keys}, "text": pa.array([g[0] for g in got], pa.string()), "n_markup": pa.array([g[1] for g in got], pa.int32()), "cut": pa.array([g[2] for g in got], pa.string())})

    return texts.select(*keys, "text").mapInArrow(run, schema)
