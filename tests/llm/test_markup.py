import pytest

from foliospark.llm import markup
from foliospark.llm.markup import clean, fit, labelled_pages, region, tokens

PLAIN = [
    "# Head\n\n- a **b** *c* ~~d~~ [x](y) ![z](figures/a.png)\n\n| a | b |\n|---|---|\n| 1 | 2 |", "x < y and y > 88", "A 3'' hose and a 6'' hose", "Store it under C:\\nozzle\\shaft here",
    "It costs $24, not $218.", "Enter <serial number> and <frame code> on the form.", "Call `[[seal]]` or `{{manifest}}` or `<b>x</b>`", "```html\n<div class=\"a\"><b>x</b></div>\n```",
    "~~~tex\n\\textbf{x} \\cite{y}\n~~~", "$$E = m_c \\cdot v^2 / 8$$", "The loss is $\\frac{5}{3} \\alpha^2$ here", "AT&T & R&D", "Text\n\n    <b>indented code</b>\n", "", "\\\\server\\share", "a \\* b \\_c\\_",
]
MARKED = {
    "a <b>bold</b> word": "a **bold** word", "x<br/>y": "x\ny", "<!-- scan 3 -->Plain": "Plain", "fine&nbsp;and &amp; so": "fine and & so", "stray </td> end": "stray end", "<DIV>A b c d e</DIV>": "A b c d e",
    "<ul><li>one of it</li><li>two</li></ul>": "- one of it\n- two", "see <a href=\"#s8\">here</a> or <a href=\"u\">there it is</a>": "see here or [there it is](u)",
    "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table> words here to keep it so that they win over every tag in it by far and more words still": "| a | b |\n|---|---|\n| 1 | 2 |\n\nwords here to keep it so that they win over every tag in it by far and more words still",
    "the '''bold''' and ''slanted'' words": "the **bold** and *slanted* words", "== Some heading ==\nText": "## Some heading\n\nText", "at [[target page|the]] desk": "at the desk", "on [[File:x.png|thumb]] the": "on the",
    "{{Notice|sensor|36}}\nText of it": "Text of it", "Words here\n{| class=grid\n|-\n| be || 245 g\n|}": "Words here\n\n| be | 245 g |\n|---|---|",
    "\\section{A head} and text": "## A head\n\nand text", "so \\textbf{bold} and \\emph{slanted} it": "so **bold** and *slanted* it", "shown~\\cite{x} before": "shown before",
    "\\begin{itemize}\n\\item One thing\n\\item Two things\n\\end{itemize}": "- One thing\n- Two things", "a note\\footnote{as said} here": "a note (as said) here",
}


@pytest.mark.parametrize("text", PLAIN)
def test_left_alone(text):
    assert clean(text) == (text, 0, None)


@pytest.mark.parametrize("text", MARKED)
def test_cleaned(text):
    got, n, _ = clean(text)
    assert n > 0
    assert " ".join(got.split()) == " ".join(MARKED[text].split()) if "\n" not in MARKED[text] else [x.strip() for x in got.split("\n") if x] == [x for x in MARKED[text].split("\n") if x]


def test_code_and_formulas_survive():
    text = "<p>Run</p>\n\n```\na <b> &amp; \\x{y}\n```\n\nwith `<i>` and $\\frac{1}{2}$."
    got, *_ = clean(text)
    assert "```\na <b> &amp; \\x{y}\n```" in got and "`<i>`" in got and "$\\frac{1}{2}$" in got and "<p>" not in got


TEXTS = [f"# Pump {k}\n\nThe pump of hall {k} was drained and its valve reset before noon.\n\n- one item of it\n\nThen all of the crew left for the day, and nobody came back until week {k} was over." for k in range(40)]


def test_region_of_labelled_pages():
    """Fitted on labelled pages, the regions of others lose nothing and leave out most navigation."""
    scores = (markup.WORD_SCORE, *fit(labelled_pages(TEXTS[:20], 1)))
    around = kept = 0
    for text, content in labelled_pages(TEXTS[20:], 2):
        a, b, _ = region(text, tokens(text), scores)
        assert content in text[a:b]
        around, kept = around + len(text) - len(content), kept + b - a - len(content)
    assert kept < 0.2 * around


def test_region_against_all_spans():
    text = "a <nav> b c d <b> <nav> e f g <nav> h"
    sequence = markup.events(text, tokens(text))
    scores = (1.0, -1.0, -1.0, -0.5)
    best = max(sum(scores[k] for _, _, k in sequence[i:j]) for i in range(len(sequence)) for j in range(i + 1, len(sequence) + 1))
    a, b, negatives = markup.scan(sequence, scores)
    assert sum(scores[k] for x, y, k in sequence if x >= a and y <= b) == best == 4.5 and negatives == 4


def test_no_prose_is_cut():
    links = "".join(f'<li><a href="/m{k}">Manual of the pump in hall {k}</a></li>\n' for k in range(10))
    text = f"# Head\n\nThe pump was drained by the crew.\n\n<ul>\n{links}</ul>\n\nNobody came back until the week was over."
    got = clean(text)
    assert got.cut is None and got.text.count("Manual of the pump") == 10 and got.text.endswith("week was over.")
    references = "A short text.\n\n## References\n\n" + "\n".join(f'<a href="u{k}">First pump handbook {k}</a>' for k in range(30))
    assert clean(references).text.count("handbook") == 30
    menu = '<nav><a href="/">Home</a> <a href="/n">News</a></nav>\n'
    got = clean(menu + "The pump was drained by the crew and its valve reset.\n\n" + menu * 2 + "\nHe said so.\n\n" + menu)
    assert "He said so." in got.text and got.cut.count("Home") == 2 and "Home" in got.text
    code = menu + "Run this one now, and wait until it ends.\n" + "<br>" * 40 + "\n```\nrun\n```"
    assert "```\nrun\n```" in clean(code).text


def test_spark(spark):
    rows = [("a", "x <b>y</b>", 1), ("n", None, 1), ("e", "", 1), ("p", "plain", 1), ("a", "x <b>y</b>", 1)]
    df = spark.createDataFrame(rows, "job_id string, text string, n_markup int")
    got = sorted((r.job_id, r.text, r.n_markup) for r in markup.cleaned(df, ["job_id"]).collect() if r.text is not None)
    assert got == [("a", "x **y**", 2), ("a", "x **y**", 2), ("e", "", 0), ("p", "plain", 0)]
    assert markup.cleaned(df.limit(0), ["job_id"]).count() == 0
