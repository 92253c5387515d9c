"""Rules of the catalogue and of text, with expected values written by hand."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyglass.functions.exprs import slug
from tallyglass.operators import catalog, ocr, prices

KANA = "[぀-ヿ一-鿿]"


def test_totals_of_any_length(spark):
    titles = ["A (Set 001/029)", "B (Set 001/99999999999)", "C (Set 1/99999999999999999999)", "D (Promos 051/ADV-P)", "E (Deck No. 7)", "F (Pack (F) 1)", "(Set 1)", "no reference"]
    got = {r.name: (r.set_name, r.card_number, r.set_total) for r in catalog.parse_listing_titles(spark.createDataFrame(list(enumerate(titles)), "card_id long, alt_text string")).collect()}
    assert got == {"A": ("Set", "1", 29), "B": ("Set", "1", 99999999999), "C": ("Set", "1", None), "D": ("Promos", "51", None), "E": ("Deck", "7", None), "F": ("Pack (F)", "1", None)}
    text = spark.createDataFrame([(1, "ピカチュウ 12/99999999999"), (2, "ピカ 1/99999999999999999999"), (3, "Pika 3/4")], "scan_id long, text string")
    assert [tuple(r)[2:] for r in ocr.detect_language(text).orderBy("scan_id").collect()] == [("ピカチュウ", "12", 99999999999), ("ピカ", "1", None), (None, None, None)]


@pytest.mark.parametrize(
    ("html", "title"),
    [
        ("<h2>カテゴリ</h2><h1>ピカチュウ</h1>", "ピカチュウ"),
        ("<h1>Cards</h1><h2> <b>リザ</b>\n <i>ードン</i> </h2>", "リザードン"),
        ('<p>説明の文</p><span class="big card-name">フシギダネ</span>', "フシギダネ"),
        ("<div class=name>ゼニガメ</div><div class='card-name'>カメール</div>", "カメール"),
        ('<div class="sub-title-x">カメックス</div><div class="username">違う</div>', "カメックス"),
        ('<div class="x">あ</div><li>長い' + "い" * 40 + "</li><li>© 会社</li><li>二\n行</li><li> ミュウ </li>", "ミュウ"),
        ("<h1>no kana</h1>", None),
        ("<h1>" + "ア" * 40 + "</h1><h2>イ</h2>", None),
    ],
)
def test_titles_by_place(spark, html, title):
    page = spark.createDataFrame([(1, f"<img src='/img/ab/001.jpg'>{html}")], "page_id long, html string")
    got = catalog.extract_detail_pages(page, r"/img/(\w+)/(\w+\.jpg)", "nothing", KANA).first()
    assert (got.title, got.set_code) == (title, "ab")


def test_files_of_cards(spark):
    cards = spark.createDataFrame([(1, "Base Set!", "TG12"), (2, "Base Set!", "007"), (3, "!Jungle", "4"), (4, "Base Set!", "9"), (5, "Base Set!", "000")], "card_id long, set_name string, card_number string")
    paths = ["r/base-set/x-12_a.PNG", "r/base-set/x_7.png", "r/base-set/z-007.jpg", "r/base-set/a.7.txt", "r/jungle/4.webp", "r/base-set/9a-b9.png", "r/base-set/1_0.jpeg", "r/base-set/.png", "r/base-set/9"]
    got = catalog.match_files_to_cards(spark.createDataFrame([(p,) for p in paths], "path string"), cards).collect()
    assert {tuple(r) for r in got} == {(1, "r/base-set/x-12_a.PNG"), (2, "r/base-set/z-007.jpg"), (5, "r/base-set/1_0.jpeg")}


def plain_slug(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t.lower().strip()) if not unicodedata.combining(c))
    return re.sub(r"[\s-]+", "-", re.sub(r"[^a-z0-9\s-]", "", t)).strip("-")


def test_slugs(spark):
    texts = ["Ōsaka Promo", "Šárka", "Ｆｕｌｌ Width", "tab\there", "Pokémon & Co. + 'x'", "--a -- b--", "ﬁre ½ Ⅷ", "ÅÄÖ ß ø", "ポケモン", "", "  x y z "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(slug(F.col("t"))).collect()]
    assert got == [plain_slug(t) for t in texts] and got[:4] == ["osaka-promo", "sarka", "full-width", "tab-here"]


def test_slugs_of_every_character(spark):
    """All of the first two planes, but for surrogates and those whose lower case the two sides do not share."""
    chars = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000 and len(chr(c).lower()) == 1]
    found = spark.createDataFrame([(c, f"a{c}b") for c in chars], "c string, t string").select("c", F.lower("c").alias("low"), slug(F.col("t")).alias("s")).collect()
    wrong = [r.c for r in found if r.low == r.c.lower() and r.s != plain_slug(f"a{r.c}b")]
    assert not wrong, [f"{ord(c):x}" for c in wrong[:20]]


def test_maker_is_no_name(spark):
    scans = spark.createDataFrame([(1, "pokemon", "en", "Gamefreak\nPikachu HP 60"), (2, "pokemon", "en", "Game Freak\nPikachu HP 60")], "scan_id long, game string, language string, raw_text string")
    names = spark.createDataFrame([("pikachu",), ("gamefreak",), ("game",), ("freak",)], "name string")
    assert {r.name for r in ocr.find_name(scans, names).collect()} <= {"Pikachu"}


def test_price_page_attributes(spark):
    page = lambda html: spark.createDataFrame([(1, html)], "page_id long, html string")
    html = "<div data-x=1 id=full-prices class='a'><table><TR class=r><th>Ungraded</th><td class=price>$1,234.50</td></TR><tr><td> PSA 10 </td><td>$7 <span class='x listed-price-inline'>$9</span></td></tr><tr><td>Grade 9</td></tr></table></div>"
    got = prices.extract_prices(page(html)).first()
    assert (got.ungraded, got.grade_9, got.grade_10) == (1234.5, None, 7.0)
    spare = "<td class='x' id='used_price'><span class=\"price js-price\">$3.25</span></td><p id=\"full-prices-note\">x</p>"
    assert prices.extract_prices(page(spare)).first().ungraded == 3.25
    assert tuple(prices.extract_prices(page("")).first())[1:] == (None,) * 5


def test_sale_page_attributes(spark):
    cells = "<td>2024-01-01<td></td><td>x</td>"
    html = (
        "<table id=t class='sortable js hoverable-rows'><tr><th>h</th></tr><tr class=r><td>2024-01-02</td><td></td><td>T <a target=_blank href='/offer/7'>o</a></td>"
        "<td><span class='q' title='best offer accepted price'>$4</span> <span class=listed-price-inline>$9</span></td></tr>"
        "<tr><td>2024-01-03</td><td><a href=http//mercari.example/1>m</a></td><td>U</td><td><span class=listed-price-inline>$9</span>$5</td></tr></table>"
        f"<table class=sortable><tr>{cells}<td>$1</td></tr></table>"
    )
    got = prices.extract_sales(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("at").collect()
    assert [(r.at, r.title, r.price, r.url) for r in got] == [(1, "T o", 4.0, "https://prices.example/offer/7"), (2, "U", 5.0, "http://mercari.example/1")]


def test_certificate_counts_of_any_length(spark):
    html = "<H1 class=x>Name</H1><dl><dt class=a>Population</dt><dd>99,999,999,999</dd><dt>Pop Higher</dt><dd class='b'>1,200</dd></dl>"
    got = prices.extract_certificates(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (got.name, got.population, got.higher) == ("Name", None, 1200)


def test_search_hit_attributes(spark):
    html = "<table class=x id='games_table'><tr id=p-1 data-product=1><td data-a=1 class='image title'><a title='t' href='/game/s/c-1'>C</a></td><td class='price numeric price1'>$2</td></tr></table>"
    got = prices.extract_search_hits(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (got.title, got.hit_id, got.price1, got.price2) == ("C", "c-1", 2.0, None)
