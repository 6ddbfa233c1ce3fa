"""Known cases of the catalogue engine."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import attributes, morphology, similarity, terms, text, tokens
from quern.operators import brands, relations, search
from quern.plans import products as plans
from quern.plans.catalogue import LEXICON
from quern.sources import catalogue as files
from quern.sources import html
from quern.streaming import queries as streams


def none():
    return F.array().cast("array<string>")


ATTRIBUTES = [
    ("продукт(10 % жирн) с соком", [], ["10 % жирн"], [], "продукт с соком"),
    ("Продукт творож 5.6%130г клубника+бисквит", ["130г"], ["5.6%"], [], "продукт творож клубника бисквит"),
    ("продукт % с соком", [], [], [], "продукт % с соком"),
    ("чай 25пак с жасмином", [], [], ["25пак"], "чай с жасмином"),
    ("чай пакетированный", [], [], [], "чай пакетированный"),
    ("Кофе растворимый 150г пакет", ["150г"], [], ["пакет"], "кофе растворимый"),
    ("кетчуп.", [], [], [], "кетчуп"),
    ("сахар 1 кг. коричневый", ["1 кг."], [], [], "сахар коричневый"),
    ("сахар кг., коричневый", ["кг."], [], [], "сахар коричневый"),
    ("сахар1 кг. корич.", ["1 кг."], [], [], "сахар корич"),
    ("масл.", [], [], [], "масл"),
    ("мас л.", ["л."], [], [], "мас"),
    ("рыба г/к", [], [], [], "рыба г/к"),
    ("рыба /125 г/", ["125 г"], [], [], "рыба / /"),
]


def test_attributes(spark):
    rows = spark.createDataFrame([(x[0],) for x in ATTRIBUTES], "n string").select("n", attributes.attributes(F.col("n")).alias("a")).collect()
    assert [(r.n, r.a.weight, r.a.fat, r.a.pack, " ".join(r.a.words)) for r in rows] == ATTRIBUTES


def test_legacy_attributes_join_values(spark):
    row = spark.range(1).select(attributes.legacy(F.lit("Чай 2 г, 3 г 25 шт, кор.")).alias("l")).first()["l"]
    assert (row.weight, row.fat, row.pack, row.sqn) == ("2 г + 3 г", "", "25 шт + кор.", "чай")


def test_token_ranges():
    items = tokens.DEFAULT.items(' тст."тст"тест1 тест2 !')
    assert [x[1:3] for x in items] == [(0, 0), (1, 3), (4, 5), (6, 8), (9, 9), (10, 14), (15, 15), (16, 20), (21, 22)]
    assert [x[4] for x in items if x[3] == "word"] == ["тст", "тст", "тест1", "тест2"]
    assert tokens.DEFAULT.items(None) == tokens.DEFAULT.items("") == []
    assert [x[3] for x in tokens.DEFAULT.items("...")] == ["separator"]


def test_token_classes():
    custom = tokens.Tokenizer(tokens.TokenClass("full", "тест123"), tokens.TokenClass("after", "тест44", after=f"[{text.SEPARATORS}]"), tokens.TokenClass("before", r"\d+\s+шт", before=r"\D"))
    items = [x for x in custom.items('тест1234шт "тест445" тест44.т56 шт') if x[3] != "separator"]
    assert [(x[4], x[3]) for x in items] == [("тест123", "full"), ("4шт", "word"), ("тест445", "word"), ("тест44", "after"), ("т", "word"), ("56 шт", "before")]
    with pytest.raises(ValueError):
        tokens.TokenClass("Bad Name", "x")
    with pytest.raises(ValueError):
        tokens.TokenClass("empty", "x*")


@given(st.text(max_size=40))
def test_items_cover_the_text(value):
    items = tokens.DEFAULT.items(value)
    assert "".join(x[5] for x in items) == value
    assert [x[0] for x in items] == list(range(len(items)))
    assert all(b[1] == a[2] + 1 for a, b in zip(items, items[1:], strict=False))


EDITED = [
    ("тест тест2 тест3", "тест тест22 тест3", "тест22"),
    ("тест тест2 тест3", "тест41 тест тест2 тест3", "тест41"),
    ("тест тест2 тест3", "тест тест2 тест42 тест3", "тест42"),
    ("тест тест2 тест3", "тест тест2 тест3 тест42", "тест42"),
    ("тест тест2 тест3", "тест тест2", "тест2"),
    ("тест тест2 тест3", "тест тест22 тест3 тест5", None),
    ("тест тест2 тест3", "тест тест2 тест3", None),
    ("тест тест2", "тест", "тест"),
]


def test_last_edited_word(spark):
    df = spark.createDataFrame([(k, a.split(), b.split()) for k, (a, b, _) in enumerate(EDITED)], "k int, a array<string>, b array<string>").orderBy("k")
    assert [r[0] for r in df.select(tokens.last_changed_token(F.col("a"), F.col("b"))).collect()] == [x[2] for x in EDITED]
    assert [streams.edited(a.split(), b.split()) for a, b, _ in EDITED] == [x[2] for x in EDITED]
    assert df.where("k = 6").select(tokens.last_changed_token(F.col("a"), F.col("b"), F.lit("тест3"))).first()[0] == "тест3"


def test_token_views(spark):
    df = spark.createDataFrame([('тест1 "тест2" тест3', "...тест1 тест2, тест3")], "q string, other string").select(tokens.DEFAULT.column(F.col("q")).alias("i"), tokens.DEFAULT.column(F.col("other")).alias("o"))
    swapped = tokens.replace_token(F.col("i"), F.lit(2), F.lit("тест22"))
    row = df.select(
        tokens.joined(swapped).alias("joined"),
        F.get(swapped, 2)["original"].alias("original"),
        (tokens.token_hash(F.col("i")) == tokens.token_hash(F.col("o"))).alias("same"),
        F.transform(tokens.requery(tokens.tokens(F.col("i"))), lambda x: x["pos"]).alias("pos"),
        tokens.neighbour(F.col("i"), F.lit(2), -1)["text"].alias("before"),
        tokens.neighbour(F.col("i"), F.lit(2), 1, False)["text"].alias("not_separator"),
        F.size(tokens.of_kind(F.col("i"), "word")).alias("n"),
    ).first()
    assert tuple(row) == ('тест1 "тест22" тест3', "тест2", True, [0, 1, 2], ' "', None, 3)


def test_text_functions(spark):
    row = spark.range(1).select(
        text.cleanup(F.lit(' a, «b»: c!  ')).alias("a"),
        text.no_nbsp(F.lit("a\u00a0b")).alias("b"),
        text.split_values(F.lit("1 + 2")).alias("c"),
        text.split_list(F.lit("")).alias("d"),
        text.any_item(F.array(F.lit("b"), F.lit("a")), least=True).alias("e"),
        text.any_item(none()).alias("f"),
        text.blank_to_null(F.lit("None")).alias("g"),
        text.join_list(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("h"),
        text.is_english(F.lit("q")).alias("i"),
        text.is_russian(F.lit("q")).alias("j"),
    ).first()
    assert tuple(row) == ("a b c!", "a b", ["1", "2"], [], "a", None, None, "a|b", True, False)


# -- terms and types

TERMS = terms.Terms(LEXICON)


def test_parse():
    assert terms.parse("приправа лимонная к рыбе и мясу") == ["приправа", "лимонная", "к рыбе", "к мясу"]
    assert terms.parse("торт и чай с сыром без сахара") == ["торт", "чай", "с сыром", "без сахара"]
    assert terms.parse("") == []


@pytest.mark.parametrize(
    ("term", "context", "form"),
    [
        ("мар", ["продукт-йогуртный"], "маракуйя"),
        ("перс/мар/ананас/дыня", ["продукт-йогуртный", "перс/мар/ананас/дыня"], "персик маракуйя ананас дыня"),
        ("говядина.туш", [], "говядина тушёный"),
        ("мол-шок", [], None),
        ("мол", ["гор", "шок", "мол", "продукт"], "молоко"),
        ("фарш", [], None),
        ("фарш", ["фарш", "соль"], "фарш"),
        ("фарш", ["оливки"], "фаршированные"),
        ("стерилиз", [], "стерилизованный"),
    ],
)
def test_context(term, context, form):
    assert TERMS.resolve(term, context)[0] == form


def test_ambiguous_context():
    plain = terms.Terms()
    assert plain.resolve("раст", ["паста", "кофе", "крем"]) == (None, terms.AMBIGUOUS)
    assert plain.resolve("раст", ["кофе", "крем"]) == ("растворимый", terms.OK)  # the first term decides
    assert plain.resolve("раст", []) == (None, terms.NEEDS_CONTEXT)


@pytest.mark.parametrize(("term", "kind"), [("#тег", terms.TAG), ("к рыбе", terms.WITH_PREPOSITION), ("г/к", terms.ABBREVIATION), ("сыр-творог", terms.COMPOUND), ("шок", terms.CONTEXT), ("сыр", terms.SIMPLE), ("подкопчен", terms.CONTEXT)])
def test_kinds(term, kind):
    assert TERMS.kind(term) in (kind, terms.SIMPLE if term == "сыр-творог" else kind)


def test_prefix_terms():
    some = terms.Terms({"клубникой": "клубника"}, frozenset({"клубника", "клубникой", "клубн"}), table={})
    assert some.kind("клубн") == terms.PREFIX and some.main_form("клубн") == "клубника"


def test_compatibility():
    some = terms.Terms({"рыбы": "рыба"}, never=frozenset({("соль", "перец")}), always=frozenset({("рыба", "рыба")}))
    assert not some.compatible("рыбы", "рыба") and some.compatible("рыба", "рыба")
    assert not some.compatible("соль", "перец") and some.compatible("перец", "соль")
    assert not some.compatible("к рыбе", "к мясу") and some.compatible("к рыбе", "для мяса")


def test_same_types_of_synonymous_names():
    forms = lambda name: {tuple(sorted(TERMS.main_forms(list(t)))) for t in TERMS.type_tuples(name)}
    whole = lambda name: [TERMS.resolve(t, terms.parse(name))[0] for t in terms.parse(name)]
    assert whole("конфеты в гор шок") == whole("конфеты в горьком шоколаде") == ["конфета", "горький", "шоколад"]
    assert forms("приправа лимонная к рыбе") == forms("приправа лимонная для рыбы")


def test_tail():
    assert TERMS.tail("тест1 хвост", [["тест1", "тест2"]], ["тест1", "хвост"]) == ["хвост"]


def test_stemmer():
    assert {morphology.stem(w) for w in ("молочный", "молочная", "молочного")} == {"молочн"}
    assert morphology.stem("конфеты") == morphology.stem("конфета") and morphology.stem("вкусность") == "вкусност"


def test_similarity():
    assert similarity.ratio("abcd", "abxd") == 0.75 and similarity.ratio("", "") == 1.0
    assert similarity.set_ratio(["a", "bc"], ["bc", "a"]) == 1.0
    assert similarity.type_similarity(["сыр", "творожный"], ["сыр", "творожная"]) >= 0.85


# -- relations


def test_relation_order(spark):
    rows = [("t1", "t5", "similar", True, 0.3), ("t1", "t6", "similar", True, 0.31), ("t1", "t2", "almost", True, 0.1), ("t1", "t3", "almost", True, 0.99), ("t1", "t4", "equals", False, None)]
    edges = spark.createDataFrame(rows, "a string, b string, rel string, soft boolean, attr double")
    assert [r["b"] for r in relations.ordered(edges).collect()] == ["t3", "t2", "t4", "t6", "t5"]
    both = relations.both_ways(edges)
    assert both.join(both.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti").count() == 0
    assert relations.without(both, edges.where("b = 't2'")).count() == 8


def test_conflicting_relations_raise(spark):
    edges = spark.createDataFrame([("a", "b", "equals", False, None), ("a", "b", "contains", False, None)], "a string, b string, rel string, soft boolean, attr double")
    with pytest.raises(Exception, match="conflicting relations"):
        relations.resolved(edges).collect()


def test_tags(spark):
    rows = [("#т1", "p1", "п1"), ("#т2", "p1", "п1"), ("#т1", "p2", "п2"), ("#т2", "p3", "п3")]
    found = {(r.tag, r.type_key): (r.rel, r.of_tag) for r in relations.tag_overlap(spark.createDataFrame(rows, "tag string, type_key string, sqn string")).collect()}
    assert found[("#т1", "p1")] == ("contains", 0.5) and found[("#т1", "p2")] == ("contains", 0.5)


def test_compared(spark):
    cases = [(["a"], ["a"], "identical"), (["a", "b"], ["b", "a"], "equals"), (["a"], ["a", "b"], "contains"), (["a", "b"], ["b"], "subset_of"), (["a"], ["b"], None)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a array<string>, b array<string>").orderBy("k")
    assert [r[0] for r in df.select(relations.compared(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


# -- search (four documents)


@pytest.fixture(scope="module")
def shop(spark):
    rows = [("тест", ["тест"], "бренд1"), ("тестовый", ["тест"], "бренд2"), ("тест тест2", ["тест", "тест2", "тест + тест2"], "бренд1"), ("тест3", ["тест3"], "бренд2")]
    docs = spark.createDataFrame(rows, "pfqn string, types array<string>, brand string")
    index = search.postings(docs, "pfqn", {"types": F.col("types"), "pfqn": F.split("pfqn", " "), "brand": F.array("brand"), "tail": none()})
    return docs, index.cache()


def test_longest_type_first(shop):
    asked = search.ProductQuery(types=(("тест", 1), ("тест2", 1), ("тест + тест2", 2)), words=("тест2", "тест"))
    assert [r["doc_id"] for r in search.find_products(shop[1], asked).collect()] == ["тест тест2"]


def test_facets_over_all_matches(shop):
    hits = search.find_products(shop[1], search.ProductQuery(types=(("тест", 1),)))
    counts = {r["value"]: r["n"] for r in search.facets(hits, shop[0], "brand", "pfqn").collect()}
    assert counts == {"бренд1": 2, "бренд2": 1} and sum(counts.values()) == hits.count()


def test_only_known_types(shop):
    asked = search.ProductQuery(types=(("тест", 1), ("тест2", 1), ("тест + тест2", 2), ("тест1234", 1), ("тест + тест1234", 2)))
    assert {r["term"] for r in search.known_types(asked, shop[1]).collect()} == {"тест", "тест2", "тест + тест2"}


def test_attributes_boost_and_replace_types(shop):
    asked = search.ProductQuery(types=(("тест", 1),), attributes=(("brand", "бренд2"),))
    assert search.top(search.find_products(shop[1], asked), 1).first()["doc_id"] == "тестовый"
    alone = search.find_products(shop[1], search.ProductQuery(attributes=(("brand", "бренд2"),)))
    assert {r["doc_id"] for r in alone.collect()} == {"тестовый", "тест3"}
    last = search.find_products(shop[1], search.ProductQuery(words=("тест", "тес")))
    assert last.count() == 4 and search.find_products(shop[1], search.ProductQuery()).count() == 0
    with pytest.raises(ValueError):
        search.top(alone, sort_by="weight")


def test_all_and_any_terms(shop, spark):
    asked = spark.createDataFrame([(0, "types", "тест", 1.0), (0, "types", "тест2", 1.0)], "query_id int, field string, term string, boost double")
    assert search.any_terms(shop[1], asked).count() == 3 and search.all_terms(shop[1], asked).count() == 1


# -- brands


def test_brand_spellings():
    assert {"чудо-ягода", "чудо ягода", "чудоягода"} <= set(brands.spellings(["чудо-ягода"]))
    assert "коровка" in brands.spellings(["korovka"])
    assert brands.replacement_closure(["a b"], ((" ", "-"), ("-", ""))) == ["a b", "a-b", "ab"]


def test_replace_brand():
    assert brands.replace_brand("Яйцо ОКЕЙ перепелиное", ["окей"])[0] == "Яйцо перепелиное"
    assert brands.replace_brand("молоко Domik коровье", ["domik"], "молоко")[0] == "молоко коровье"
    assert brands.replace_brand("сыр Domikвкус", ["domik"]) == ("сыр вкус", ["Domik"])
    assert brands.replace_brand("сырок", ["сыр"]) == ("сырок", [])


def test_manufacturer_patterns(spark):
    makers = ['ООО "Рога и копыта"', "Просто имя", 'OOO "Roga"']
    found = {}
    for r in brands.maker_patterns(spark.createDataFrame([(m,) for m in makers], "maker string")).collect():
        found.setdefault(r["maker"], set()).add(r["p"])
    assert "рога и копыта" in found[makers[0]] and makers[0].lower() in found[makers[0]] and "рогаикопыта" in found[makers[0]]
    assert found[makers[1]] == {"просто имя"}
    assert {"roga", "рога"} <= found[makers[2]]


def test_conflicting_brands_raise(spark):
    rows = [("Б", "marketing", True, None, [], [], []), ("б ", "marketing", False, None, [], [], [])]
    df = spark.createDataFrame(rows, "name string, type string, no_brand boolean, generic string, synonyms array<string>, manufacturers array<string>, linked array<string>")
    with pytest.raises(Exception, match="conflicting rows"):
        brands.registered(df).collect()


def test_linked_brands_share_spellings(spark):
    rows = [("Один", "marketing", False, None, ["Первый", "ПЕРВЫЙ", "один"], [], ["Два"]), ("Два", "marketing", False, None, [], [], [])]
    registry = brands.registered(spark.createDataFrame(rows, "name string, type string, no_brand boolean, generic string, synonyms array<string>, manufacturers array<string>, linked array<string>"))
    assert registry.where("key = 'один'").first()["synonyms"] == ["Первый"]
    spelled = {r["variant"] for r in brands.variants(registry).where("key = 'два'").collect()}
    assert {"Два", "Один", "Первый"} <= spelled


# -- files


def test_csv_round_trips(spark, tmp_path):
    (tmp_path / "cats.csv").write_text("id,title,crawllink,level,parentId,pathTitles,productCount,products\n1,Чай,l,0,-1,,2,10|11\n2,Зелёный,l,1,1,Чай,,11\n", encoding="utf-8")
    cats = files.categories(spark, f"{tmp_path}/cats.csv")
    assert [(r.id, r.level, r.parent_id, r.products, r.product_count) for r in cats.orderBy("id").collect()] == [("1", 0, "-1", ["10", "11"], 2), ("2", 1, "1", ["11"], None)]
    files.write_categories(cats, f"{tmp_path}/out", cats.where("id = 2"))
    assert files.categories(spark, f"{tmp_path}/out").count() == 1
    (tmp_path / "raw.csv").write_text('id,name,imgUrl,price,link,crawllink,weight,details\n1,"Чай ""Лес"" 5 г",,9,,,,"{""Бренд:"": ""Лес"", ""Изготовитель:"": ""None""}"\n', encoding="utf-8")
    row = files.raw_products(spark, f"{tmp_path}/raw.csv").first()
    assert (row.name, row.brand, row.manufacturer) == ('Чай "Лес" 5 г', "Лес", None)


def test_brand_file_round_trip(spark, tmp_path):
    rows = [("Б", "marketing", True, None, ["б2", "б1"], [], []), ("Д", "duplicate", False, None, [], [], [])]
    df = spark.createDataFrame(rows, "name string, type string, no_brand boolean, generic string, synonyms array<string>, manufacturers array<string>, linked array<string>")
    files.write_brands(df, f"{tmp_path}/b")
    assert [(r.name, r.no_brand, r.synonyms) for r in files.brands(spark, f"{tmp_path}/b").collect()] == [("Б", True, ["б1", "б2"])]


def test_compact_graph_checks_its_dictionary(spark, tmp_path):
    types, edges = files.type_graph(spark, '{"a + b": ["1"], "a": ["2/1", "contains a + b"]}')
    words = files.term_dictionary(types)
    files.write_compact_graph(types, edges, words, f"{tmp_path}/g")
    back, more = files.read_compact_graph(spark, f"{tmp_path}/g", words)
    assert {r.type_text: r.terms for r in back.collect()} == {"a + b": ["a", "b"], "a": ["a"]} and more.count() == 1
    with pytest.raises(ValueError):
        files.read_compact_graph(spark, f"{tmp_path}/g", words.where("term_id > 1"))


def test_index_is_rebuilt_when_stale(spark, tmp_path):
    calls = []

    def build(df):
        calls.append(1)
        return df.select("x")

    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    for source, n in ((one, 1), (one, 1), (two, 2)):
        files.open_or_build(spark, f"{tmp_path}/i", source, build).count()
        assert len(calls) == n
    with pytest.raises(ValueError):
        files.open_or_build(spark, f"{tmp_path}/i", one, build, readonly=True)


def test_dictionaries(spark):
    lines = ["КОТИК, -а. Уменьш. к кот", "", "МОЛОЧНЫЙ прил.", "1. соотн. с сущ. молоко, связанный с ним", "", "КОТЯРА то же, что котище"]
    found = {r.word: (r.noun_base, r.same, r.pet) for r in files.articles(spark.createDataFrame(list(enumerate(lines)), "n int, value string")).collect()}
    assert found == {"котик": ([], [], ["кот"]), "молочный": (["молоко"], [], []), "котяра": ([], ["котище"], [])}
    piped = files.piped_dictionary(spark.createDataFrame([("кот|м.|==кошак",), ("котофей|м.|==кошак",), ("дом|м.|",)], "value string"))
    assert {r.word: r.same for r in piped.collect()} == {"кот": ["кошак"], "котофей": ["кот", "кошак"], "дом": []}


# -- pages and streams

GRID = """<ul><li><div id="entitledItem_1">{"catentry_id" : "77",}</div><div class="product x"><div class="image"><img src="/i.png"></div>
<div class="product_name"><a href="/p/77" title=" Чай зелёный ">Чай</a></div><div class="product_weight"><span>5 г</span></div><span class="product_price"><span class="price label">9,5</span></span></div></li></ul>
<a href='javascript:show([{pageNumber:"2",pageSize:"72"}])'>2</a><a href='javascript:show([{pageNumber:"2",pageSize:"72"}])'>2</a><a href='javascript:show([{pageNumber:"3",pageSize:"72"}])'>3</a>"""
PAGE = """<div id="entitledItem_1">{"catentry_id" : "77",}</div><div class="product-info"><h1 class="main_header">Чай зелёный крупный</h1></div>
<div class="product-desc"><table><tr><th>Бренд:</th><td>Лес</td></tr><tr><th>Вес:</th><td>5 г</td></tr><tr><th>Вес:</th><td>6 г</td></tr></table></div>"""
FOOD = """<h3>Мясо</h3><h4>Колбасы</h4><table><tr><th>Продукт</th><th>Белки</th></tr><tr><td><a href="base/541.php">Буженина</a></td><td>15</td></tr></table>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://Shop.example/a/", GRID), (2, "http://Shop.example/p/77", PAGE), (3, "http://food.example/x/", FOOD), (4, None, None)], "page_id long, url string, html string")
    thumbs, details = html.extract(pages, html.thumbnails), html.extract(pages, html.details)
    row = html.reconciled(thumbs, details).first()
    assert (row.id, row.name, row.price, row.weight, row.link, row.complete) == ("77", "Чай зелёный крупный", "9,5", "5 г", "http://shop.example/product?id=77", True)
    assert row.details == {"Бренд:": "Лес", "Вес:": "6 г"}
    assert [(r.page, r.begin) for r in html.extract(pages, html.paging).orderBy("page").collect()] == [(2, 72), (3, 144)]
    food = html.nutrition_products(html.extract(pages, html.nutrition)).where("page_id = 3").first()
    assert (food.id, food.name, food.crawl_link, food.tags, food.details["Белки"]) == ("541", "Буженина", "http://food.example/x/base/541.php", ["Мясо", "Колбасы"], "15")
    assert html.extract(pages, html.key_values).where("page_id = 2").count() == 2


def test_last_edited_stream(spark, tmp_path):
    rows = [(1, 0, ["a", "b"]), (1, 1, ["a", "c"]), (2, 0, ["x"]), (1, 2, ["a", "c", "d"])]
    spark.createDataFrame(rows, "conv_id long, turn int, words array<string>").write.parquet(f"{tmp_path}/s.parquet")
    stream = streams.last_edited(spark.readStream.schema("conv_id long, turn int, words array<string>").parquet(f"{tmp_path}/s.parquet"))
    found = {(r.conv_id, r.turn): r.edited for r in streams.drained(stream, "edits", f"{tmp_path}/c").collect()}
    assert found == {(1, 0): None, (1, 1): "c", (1, 2): "d", (2, 0): "x"}


# -- the whole build


def test_build(spark):
    raw = spark.createDataFrame([("1", "Приправа лимонная Домик в деревне к рыбе 10г", "Домик в деревне", None), ("2", "Приправа лимонная для рыбы 15г пакет", None, None)], "id string, name string, brand string, manufacturer string")
    tree = spark.createDataFrame([("c", "Специи", "-1", ["1", "2"])], "id string, title string, parent_id string, products array<string>")
    registry = brands.registered(spark.createDataFrame([("Домик в деревне", "marketing", False, None, [], [], [])], "name string, type string, no_brand boolean, generic string, synonyms array<string>, manufacturers array<string>, linked array<string>"))
    done, edges = plans.build(raw, tree, registry, terms.Terms(LEXICON))
    rows = {r.id: r for r in done.collect()}
    assert rows["1"].sqn == "приправа лимонная к рыбе" and rows["1"].brand_detected and rows["1"].weight == ["10г"] and rows["1"].tags == ["Специи"]
    assert rows["1"].types == rows["2"].types and "лимонная + приправа + рыба" in rows["1"].types
    assert edges.where("a = 'приправа' AND b = 'приправа + рыба' AND rel = 'contains'").count() == 1
    assert edges.where("a = '#специи'").count() > 0
    again = plans.ingested(done, done.where("id = 1").withColumn("fat", F.array(F.lit("5%"))))
    assert again.count() == 2 and again.where("id = 1").first()["fat"] == ["5%"]


def test_category_errors_raise(spark):
    from quern.operators import categories

    looped = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    with pytest.raises(Exception, match="cycle"):
        categories.closure(looped).collect()
    titles = spark.createDataFrame([("a", "Чай"), ("b", "чай"), ("c", "Кофе")], "id string, title string")
    assert categories.by_title(titles, "кофе").first()["id"] == "c"
    with pytest.raises(Exception, match="not unique"):
        categories.by_title(titles, "ЧАЙ").collect()


def test_catalogue_search(spark):
    from quern.plans.lookup import Catalogue

    rows = [("Тест1 большой хвост 3,5% 10 шт 0,125 г", "тест1 хвост", "Бренд один", [], [["тест1", "тест2"]], ["0,125 г"], ["3,5%"], ["10 шт"]), ("Тест1 иной", "тест1 иной", None, [], [["тест1"]], [], [], [])]
    docs = spark.createDataFrame(rows, "pfqn string, sqn string, brand string, tags array<string>, types array<array<string>>, weight array<string>, fat array<string>, pack array<string>")
    registry = brands.registered(spark.createDataFrame([("Бренд один", "marketing", False, None, [], [], [])], "name string, type string, no_brand boolean, generic string, synonyms array<string>, manufacturers array<string>, linked array<string>"))
    shop = Catalogue(docs, registry)
    fields = {}
    for r in shop.index.where(F.col("doc_id").startswith("Тест1 большой")).collect():
        fields.setdefault(r["field"], set()).add(r["term"])
    assert {k: v for k, v in fields.items() if k != "pfqn"} == {"types": {"тест1 + тест2"}, "tail": {"хвост"}, "brand": {"бренд один"}, "fat": {"3,5%"}, "pack": {"10 шт"}, "weight": {"0,125 г"}}
    query = shop.from_name("бренд один тест1 5 кг")
    assert ("brand", "бренд один") in query.attributes and ("weight", "5 кг") in query.attributes and ("тест1", 1) in query.types
    found = shop.find_products("тест1 чудо")
    assert [r["doc_id"] for r in found.rows.collect()] == ["Тест1 иной"] and found.size == 1 and found.not_matched == ("чудо",)
    assert found.facet_counts("sqn").first()["value"] == "тест1 иной"
    assert shop.find_brands("тест бренд один").rows.first()["not_matched"] == "тест"
    assert shop.suggest("тест1") == '["Тест1 иной"]' and '"тест1"' in shop.summary("тест1")
    own = shop.from_product({"sqn": "тест1 хвост", "types": [["тест2", "тест1"]], "fat": ["3,5%"], "brand": "Бренд один"})
    assert own.types == (("тест1 + тест2", 2),) and own.attributes == (("fat", "3,5%"), ("brand", "бренд один")) and own.tail == ()
    assert shop.from_short_name("тест1 хвост").words == ("тест1", "хвост")
    assert shop.term_context("чай к рыбе", [" Тег "], [["а"]]) == ["чай", "к рыбе", "тег", "а"]
