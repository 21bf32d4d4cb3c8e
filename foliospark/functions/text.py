"""Text functions as Catalyst expressions: they take and return columns and stay inside generated code.

Java's \\s, \\w and \\d are ASCII-only unless (?U) is set; it is set wherever the meaning is Unicode.
A null gives null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes and quotes and their plain forms, for comparing headers.
HEADER_FORMS = ("–—‘’“”", "--''\"\"")
#: What marks an entry of a table of contents.
CONTENTS_ENTRY = r"(?i)^Table of Contents|\.{3,}|on page \d+|see page \d+"
#: Beginnings of lines that are no headings.
NO_HEADING = [
    r"\d{4}-\d{2}-\d{2}", r"Page\s+\d+", r"Copyright\s*©", r"\d+\s*$", r"[A-Z]{2,}\s*\d{4}", r"\w+@\w+\.\w+", r"https?://", r"\.\.\.", r"[\d\.\s]+$",
]
#: Ligatures, dashes, dots, spaces and signs, and what they are compared as.
CODE_FORMS = [
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "..."), ("‥", ".."), ("°", "deg"),
]
CODE_SIGNS = ("–—−․×÷            　", "---.x/             ")
#: Letter groups that recognition confuses, in the order in which they are rewritten.
DIGRAPHS = [("rn", "m"), ("ii", "ll"), ("vv", "w"), ("cl", "d"), ("ri", "n"), ("ni", "n"), ("ln", "h"), ("hl", "h")]
#: Below this ratio the overlap of words counts, so many times.
NEARLY, OVERLAP_WEIGHT = 0.7, 0.8
#: Signs of code, of commands and of configuration.
CODE_MARKS = [
    r"\bdef\s+\w+\(", r"\bclass\s+\w+", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import", r"\b(int|str|bool|float|void|char|public|private|static)\b", r"[{}();]",
    r"\b(if|else|for|while|return|function|var|let|const)\b", r"=\s*[\[{]", r"\w+\.\w+",
]
COMMAND_MARKS = [r"^\s*[a-z-]+\s+--?\w+", r"^\s*(sudo|cd|ls|cp|mv|rm|mkdir|chmod|chown)\b", r"^\s*(git|npm|pip|docker|kubectl)\b", r"\s-[a-zA-Z]\b", r"\s--\w+"]
CONFIG_MARKS = [r"^\s*\w+\s*[=:]\s*\w+", r"\w+\s*=\s*\w+", r"^\s*\[.*\]", r"^\s*#.*", r"\{[^}]*:", r"\w+\.\w+\s*=", r":\s*\d+"]
#: By mark: texts one of which every match contains; they are looked for before the mark is.
NEEDED = {
    CODE_MARKS[0]: ("def",), CODE_MARKS[1]: ("class",), CODE_MARKS[2]: ("import",), CODE_MARKS[3]: ("from",),
    CODE_MARKS[4]: ("int", "str", "bool", "float", "void", "char", "public", "private", "static"), CODE_MARKS[6]: ("if", "else", "for", "while", "return", "function", "var", "let", "const"),
    CODE_MARKS[7]: ("=",), CODE_MARKS[8]: (".",), COMMAND_MARKS[0]: ("-",), COMMAND_MARKS[3]: ("-",), COMMAND_MARKS[4]: ("--",),
    CONFIG_MARKS[0]: ("=", ":"), CONFIG_MARKS[1]: ("=",), CONFIG_MARKS[2]: ("[",), CONFIG_MARKS[3]: ("#",), CONFIG_MARKS[4]: ("{",), CONFIG_MARKS[5]: ("=",), CONFIG_MARKS[6]: (":",),
}
#: Words and shapes of Python, of device configuration, of requests.
PYTHON_WORDS = r"(?i)\b(def|class|import|from|if|elif|else|for|while|try|except|finally|with|return|yield|lambda|async|await|print)\b"
PYTHON_SHAPES = r"(?m)^\s*(def|class)\s+\w+|^\s*(import|from)\s+\w+|^\s*(if|elif|else|for|while|try|except|finally|with)\s*.*:|^\s*@\w+|^\s*#.*|print\s*\(|=\s*\[.*\]|=\s*\{.*\}"
KEY_VALUE_STOP = r"(?i)\b(def|class|import|from|if|elif|else|for|while|try|except|finally|with)\b"
DEVICE_CONFIG = r"(?i)\b(configure terminal|interface|router|ip address|vlan|spbm)\b"
DEVICE_OUTPUT = r"#\s*show\b"
HTTP_REQUEST = r"(?i)^(GET|POST|PUT|DELETE)\b"


def single_spaced(text: Column) -> Column:
    """Every run of white space as one space; runs that are one already aren't rewritten."""
    return F.regexp_replace(text, r"(?U) \s+|[^\S ]\s*", " ")


def squeeze(text: Column) -> Column:
    return F.trim(single_spaced(text))


def header_form(text: Column) -> Column:
    """The form in which headers and footers are compared: plain dashes and quotes, single spaces, lower case."""
    return F.lower(squeeze(F.translate(text, *HEADER_FORMS)))


def is_contents_entry(text: Column) -> Column:
    """Whether a text looks like an entry of a table of contents: it ends in a number, or has one of the marks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "").rlike(r"\d+\s*$") | text.rlike(CONTENTS_ENTRY)


def text_lines(text: Column) -> Column:
    """Lines of a text, words broken by a hyphen joined, trimmed; lines of one character or none are dropped."""
    joined = F.regexp_replace(text, r"(?U)-\s*\n\s*", "")
    lines = F.transform(F.split(joined, "\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(lines, lambda x: F.length(x) > 1)


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def no_heading(text: Column) -> Column:
    return text.rlike("(?iU)^(?:" + "|".join(NO_HEADING) + ")")


def alphanumerics(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def is_heading_text(text: Column) -> Column:
    """Lines that may be headings: not excluded by their beginning, 3 to 150 characters, at least half of them letters or digits."""
    return ~no_heading(text) & F.length(text).between(3, 150) & (alphanumerics(text) * 2 >= F.length(text))


def code_form(text: Column, aggressive: bool = False) -> Column:
    """The form in which code is compared; the aggressive one also rewrites confused letter groups and drops punctuation."""
    out = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    out = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), CODE_FORMS, F.translate(out, *CODE_SIGNS))
    if aggressive:
        out = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), DIGRAPHS, out)
    kept = r"[^\p{L}\p{N}\s\-_]" if aggressive else r"""[^\p{L}\p{N}\s\-_.,;:()\[\]{}="'<>/\\@#$%&*+|~`^?!]"""
    return squeeze(F.regexp_replace(single_spaced(out), kept, " "))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once however often `of` uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), of), 1)


def content_type(text: Column) -> Column:
    """code, command, config, natural_language or mixed, by the number of marks in the first 500 characters; ties go in that order. Null and short texts are mixed."""
    has = lambda x, m: reduce(Column.__or__, [x.contains(t) for t in NEEDED[m]]) & x.rlike("(?U)" + m) if m in NEEDED else x.rlike("(?U)" + m)
    marks = lambda x: F.array(*[sum((has(x, m).cast("int") for m in marks), F.lit(0)) for marks in (CODE_MARKS, COMMAND_MARKS, CONFIG_MARKS)])
    kind = lambda n, most: F.when(n[0] == most, "code").when(n[1] == most, "command").otherwise("config")
    typed = lambda n: let(F.array_max(n), lambda most: F.when(most >= 2, kind(n, most)).when(most > 0, "mixed").otherwise("natural_language"))
    return F.when(text.isNull() | (F.length(F.trim(text)) < 3), "mixed").otherwise(let(let(F.lower(F.substring(text, 1, 500)), marks), typed))


def code_class(text: Column) -> Column:
    """Which formatter a piece of code gets, in this order: json, python, config, output, http, key_value, plain; empty if blank."""
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    python = text.rlike(PYTHON_WORDS) | text.rlike(PYTHON_SHAPES)
    keyed = ~text.rlike(KEY_VALUE_STOP) & (text.contains(":") | text.rlike(r"\s{2,}"))
    other = F.when(python, "python").when(text.rlike(DEVICE_CONFIG), "config").when(text.rlike(DEVICE_OUTPUT), "output").when(text.rlike(HTTP_REQUEST), "http").when(keyed, "key_value").otherwise("plain")
    return F.when(text.isNull() | (text == ""), "empty").when(F.try_parse_json(json_form(text)).isNotNull(), "json").otherwise(other)


#: Misread keys of configuration files and what they are read as, in the order in which they are rewritten.
JSON_FORMS = [("ash-key", "ssh-key"), ("assword-encrypted", "password-encrypted"), ("rsaward-encrypted", "password-encrypted"), ("rofile", "profile"), ("rda", "role")]


def json_form(text: Column) -> Column:
    """Text as it is tried as JSON: double quotes, misread keys restored, `a=b` as `a-b`, no comma before a closing bracket."""
    out = F.replace(F.replace(text, F.lit("'"), F.lit('"')), F.lit('""'), F.lit('"'))
    out = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), JSON_FORMS, out)
    return F.regexp_replace(F.regexp_replace(out, r"(?U)(\w+)=([\w\-]+)", "$1-$2"), r"(?U),\s*([}\]])", "$1")


#: Forms of list marks, in the order in which they are tried, and what a line's beginning becomes.
BULLETS = [
    (r"(?U)^(\s*)-\s*[•◦]\s*", "$1- "), (r"(?U)^(\s*)-\s*(\d+\.)\s*", "$1$2 "), (r"(?U)^(\s*)[•◦]\s*", "$1- "), (r"(?U)^(\s*)-\s*(\d+)\s+", "$1$2. "), (r"(?U)^(\s*)(\d+)\s+", "$1$2. "),
]


def bullet_line(line: Column) -> Column:
    """A line with its list mark in standard form. Applied once only: it isn't idempotent."""
    out = line
    for form, made in reversed(BULLETS):
        out = F.when(line.rlike(form), F.regexp_replace(line, form, made)).otherwise(out)
    return out


def has_bullet(line: Column) -> Column:
    """Whether a line's list mark is of one of the forms that are rewritten."""
    return line.rlike("|".join(f"(?:{form})" for form, _ in BULLETS))


def stem(path: Column) -> Column:
    """File name without folders and suffix."""
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def figure_links(markdown: Column, base: Column) -> Column:
    """Relative links to figures as links under a base address."""
    return F.regexp_replace(markdown, F.lit(r"!\[([^\]]*)\]\(figures/([^)]+)\)"), F.concat(F.lit("![$1]("), F.regexp_replace(base, r"([\\$])", r"\\$1"), F.lit("/figures/$2)")))


def figure_path(text: Column) -> Column:
    """Path in a figure reference; empty if there is none."""
    return F.coalesce(F.regexp_extract(text, r"!\[Figure\]\(([^)]+)\)", 1), F.lit(""))


def media_type(path: Column) -> Column:
    """Media type by suffix; image/png for unknown ones."""
    known = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".webp": "image/webp", ".svg": "image/svg+xml", ".pdf": "application/pdf", ".md": "text/markdown", ".json": "application/json", ".txt": "text/plain"}
    end = suffix(path)
    return F.coalesce(*[F.when(end == k, F.lit(v)) for k, v in known.items()], F.lit("image/png"))


def rounded(value: Column, digits: int) -> Column:
    """A double of at most 2,000, not negative, to so many decimals as Python rounds it: by its exact binary value, ties to even.

    The value is compared with the middle between both candidates as a whole number of 2^-52, so nothing is lost on the way.
    """
    scale = 10**digits
    low = F.floor(value * scale)
    twice = (value * F.lit(float(2**52))).cast("bigint").cast("decimal(20,0)") * F.lit(2 * scale)
    middle = (2 * low + 1).cast("decimal(12,0)") * F.lit(2**52)
    up = (twice > middle) | ((twice == middle) & (low % 2 == 1))
    return (low + up.cast("int")).cast("double") / scale


def url_part(text: Column) -> Column:
    """A text as a part of an address: all but letters, digits and -_.* escaped, spaces too."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def data_url(content: Column, media: Column) -> Column:
    """Bytes as a base64 address of a media type."""
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def document_name(source_file: Column, path: Column) -> Column:
    """A document's name: the stem of its source file, or of the path of what was recognised; null if neither says anything."""
    name = lambda c: F.nullif(stem(c), F.lit(""))
    return F.coalesce(name(source_file), name(path))


def elapsed_text(seconds: Column) -> Column:
    """Seconds as `Ns`, from a minute on as `Nm Ns`."""
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))


def progress(step: Column, steps: int = 10) -> Column:
    """Percentage of steps done before the current one, at most 100."""
    return F.least(F.lit(100.0), (step - 1) / F.lit(steps) * 100.0)


def log_severity(line: Column) -> Column:
    """error, warning, step, success or plain."""
    step = line.rlike(r"(?i)={3,}.*STEP\s+\d+|STEP\s+\d+.*={3,}")
    return (
        F.when(line.contains("[ERROR]") | line.contains("✗"), "error").when(line.contains("[WARNING]") | line.contains("[WARN]"), "warning")
        .when(step, "step").when(line.contains("✓"), "success").otherwise("plain")
    )


def log_line(line: Column) -> Column:
    """A log line for display: separators and noise are null, step banners are `Step N: title`, levels and folders are cut off."""
    noise = line.rlike(r"^\s*={5,}\s*$") | line.rlike(r"(?i)\[(INFO|WARNING|WARN|ERROR)\]\s+(Running command|Output directory):")
    banner = r"(?i)={3,}\s*STEP\s+(\d+):\s*(.+?)\s*=*\s*$"
    plain = F.regexp_replace(line, r"(?i)^\[(INFO|WARNING|WARN|ERROR)\]\s*", "")
    short = F.trim(F.regexp_replace(plain, r"(?:/[^\s/]+)+/([\w.\-]+\.(?:pdf|json|md|txt|py|log))", "$1"))
    named = F.concat(F.lit("Step "), F.regexp_extract(line, banner, 1), F.lit(": "), F.trim(F.regexp_extract(line, banner, 2)))
    return F.when(noise | line.isNull(), None).when(line.rlike(banner), named).otherwise(F.when(short == "", None).otherwise(short))


def ratio_of_lengths(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))


def similarity_band(percent: Column) -> Column:
    """excellent from 95, good from 90, fair from 80, else poor."""
    return F.when(percent >= 95, "excellent").when(percent >= 90, "good").when(percent >= 80, "fair").otherwise("poor")
