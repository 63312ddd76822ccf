"""Extraction from generated pages whose main text is known, and its cost on pages that are broken."""

import random
import time

import pytest

WORDS = [f"word{i}" for i in range(200)] + ["naïve", "Été", "漢字", "a&b", "x<y"]


def _say(r, low, high):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(low, high))).capitalize() + r.choice([".", ".", "!", "?"])


def _escape(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("é", "&eacute;")


#: Around the article: what wraps it, with names that look like boilerplate, modifiers, forms.
WRAPPERS = [
    "<article>%s</article>", "<main>%s</main>", "<div class='layout has-sidebar'><article>%s</article></div>", "<section class='no-banner'>%s</section>",
    "<div id='main-content' class='page-search'>%s</div>", "<div class=\"sidebar-right\"><main class='widget'>%s</main></div>", "<form id=aspnetForm><div class='modal'><article>%s</article></div></form>",
    "<div class='search'><div class=post>%s</div></div>", "<table><tr><td class='story'>%s</td></tr></table>", "<div id='notice'><div>%s</div></div>",
]
#: Beside it: boilerplate of all kinds.
BESIDE = [
    "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav>", "<header class=masthead><a href='/'>The Site</a><p>All the words that are fit for everyone to read today.</p></header>",
    "<div class='ad'>Buy this thing now, it is good and cheap today.</div>", "<aside><p>Something that people also read in the last few days here.</p></aside>", "<div class='cookie-consent'><p>We use cookies on this site to make it better for you.</p></div>",
    "<footer><p>Copyright of the site, all rights reserved by the owner of it.</p></footer>", "<div class='footerLinks'><p>Some more links that stand in the footer of this page.</p></div>",
    "<form action='/s'><label>Search the whole of this site for some words here.</label><input></form>", "<script>var a = '<p>Not text at all, just a script of the page.</p>';</script>", "<style>p { margin: 0 }</style>",
    "<noscript><p>Please turn on scripts to read this page with all its parts.</p></noscript>", "<ol class='commentlist'><li><p>A reader wrote quite a long comment about this here, and another one.</p></li></ol>",
    "<div id='comments'><article class='comment'><p>Another reader did not agree with the first one, and said so.</p></article></div>", "<!-- <p>A comment of the author, not of a reader, that nobody sees.</p> -->",
    "<svg class='i'/>", "<select-box></select-box>", "<template><p>A template of a part that is not on the page yet.</p></template>",
]


def page(seed):
    r = random.Random(seed)
    blocks = [_say(r, 3, 8)] + [_say(r, 12, 60) for _ in range(r.randint(3, 9))]
    body = f"<h1>{_escape(blocks[0])}</h1>" + "".join(f"<p>{_escape(b)}{r.choice(['</p>', '', chr(10)])}" for b in blocks[1:])
    body = body.replace(" word1 ", " <b>word1</b>\n ").replace(" word2 ", " <a href='/w'>word2</a> ")
    before, after = ("".join(r.sample(BESIDE, r.randint(0, 6))) for _ in range(2))
    html = f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{WRAPPERS[seed % len(WRAPPERS)] % body}{after}</body></html>"
    return html, " ".join(blocks)


@pytest.mark.parametrize("wrapper", range(len(WRAPPERS)))
def test_main_text_of_generated_pages(wrapper):
    from topograph.llm.html_extract import main_text

    for seed in range(wrapper, 40 * len(WRAPPERS), len(WRAPPERS)):
        html, want = page(seed)
        assert main_text(html) == want, html


def test_pages_without_an_article_have_no_text():
    from topograph.llm.html_extract import main_text

    for piece in BESIDE:
        assert main_text(f"<body>{piece}</body>") == ""
    assert main_text("<p>a</p><svg class='i'/><p>The article goes on after an icon that closes itself.</p>").endswith("closes itself.")


def test_names_by_whole_words():
    from topograph.llm.html_extract import name_verdict

    assert [name_verdict(n)[0] for n in ("has-sidebar", "no-banner", "main-content page-search", "adjacent headland", "footerLinks", "commentlist", "post-comments", "story", "")] == [0, 0, 0, 0, -1, -1, -1, 1, 0]


@pytest.mark.parametrize("unit", ["<a ", '<a href="x ', "<a 'b", "<div><b>", "<", "</", "<!-- ", "<script>", "<p>short<br><b>", "<li>x <a href=y>z</a>", "<p>Just a few words"])
def test_broken_pages_take_linear_time(unit):
    from topograph.llm.html_extract import main_text

    page = "<article><p>These are the first words of the article, whole.</p>" + unit * (1_000_000 // len(unit))
    begun = time.time()
    assert main_text(page).startswith("These are the first words of the article, whole.")
    assert time.time() - begun < 30


PROSE = "<p>" + "The quiet river ran past the old mill and on to the sea. " * 4 + "</p>"


@pytest.mark.parametrize("tag", ["nav", "aside", "footer", "header", "menu", "form"])
def test_boilerplate_that_is_never_closed_does_not_swallow_the_article(tag):
    from topograph.llm.html_extract import main_text

    want = main_text(f"<article>{PROSE}</article>")
    assert want.count("quiet") == 4
    assert main_text(f"<body><{tag}><a href='/'>Home</a><article>{PROSE}</article></body>") == want
    assert main_text(f"<body><{tag}><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul><article>{PROSE}") == want
    assert main_text(f"<body><article>{PROSE}</article><{tag}><a href='/'>Home</a>") == want


@pytest.mark.parametrize("name", ["kommentare", "leser-kommentar", "werbung", "anzeige", "commentaires", "publicidad", "comentarios", "pubblicita", "fusszeile", "navegacion"])
def test_names_of_other_languages(name):
    from topograph.llm.html_extract import main_text

    other = f"<div class='{name}'><p>Noch ein Satz von vielen Worten, der nicht zum Artikel gehört.</p></div>"
    assert main_text(f"<body>{other}<article>{PROSE}</article>{other}</body>") == main_text(f"<article>{PROSE}</article>")
