"""The search surface: one object over a catalogue's tables, with lazy result sets."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import attributes, morphology, text
from quern.functions.terms import CONTEXT, Terms, parse
from quern.functions.tokens import DEFAULT
from quern.operators import brands, search


@dataclass
class ResultSet:
    """Rows of a search, computed when asked for.  ``hits`` has the whole match set, ``rows`` what the limit leaves."""

    query: object
    hits: DataFrame
    rows: DataFrame
    docs: DataFrame
    matched: tuple[str, ...] = ()
    asked: tuple[str, ...] = ()

    @cached_property
    def size(self) -> int:
        return self.hits.count()

    def facet_counts(self, name: str) -> DataFrame:
        """(value, n) over all matches, not only the rows shown."""
        return search.facets(self.hits, self.docs, name, "doc_id")

    @property
    def not_matched(self) -> tuple[str, ...]:
        return tuple(w for w in self.asked if w not in self.matched)

    def data(self, *fields: str) -> DataFrame:
        return self.rows.select(*fields) if fields else self.rows


@dataclass
class Catalogue:
    """products: pfqn, sqn, brand, tags, types (arrays of terms), weight, fat, pack.  registry: registered brands."""

    products: DataFrame
    registry: DataFrame
    terms: Terms = field(default_factory=Terms)

    @property
    def spark(self) -> SparkSession:
        return self.products.sparkSession

    @cached_property
    def docs(self) -> DataFrame:
        return self.products.withColumn("doc_id", F.col("pfqn"))

    @cached_property
    def index(self) -> DataFrame:
        """The product index: seven fields of terms."""
        keys = F.transform("types", lambda t: text.type_key(t))
        docs = self.docs.withColumn("tail", self._tails()).withColumn("_pfqn", morphology.analyzed_column(F.col("pfqn"), self.terms))
        docs = docs.withColumn("_tail", morphology.analyzed_column(F.array_join("tail", " "), self.terms))
        return search.postings(docs, "doc_id", {"types": keys, "pfqn": F.col("_pfqn"), "tail": F.col("_tail"), "brand": F.array_compact(F.array(F.lower("brand"))), "weight": F.col("weight"), "pack": F.col("pack"), "fat": F.col("fat")})

    @cached_property
    def brand_index(self) -> DataFrame:
        return brands.index(self.registry, self.products)

    def _tails(self):
        """Words of the short name that no word of the product's types covers."""
        covered = F.flatten(F.transform("types", lambda t: F.flatten(F.transform(t, lambda x: F.split(x, " ")))))
        return F.array_except(F.split(F.lower("sqn"), " "), covered)

    # -- queries

    def from_name(self, name: str, context: list[str] | None = None, type_filter: Callable[[list[str]], bool] | None = None, with_brand: bool = True) -> search.ProductQuery:
        """A full product name or a free query, parsed: attributes, brand, types and words."""
        one = self.spark.createDataFrame([(name,)], "n string").select(attributes.attributes(F.col("n")).alias("a")).first()["a"]
        words = [w for w in one["words"] if w]
        found = [("weight", v) for v in one["weight"]] + [("fat", v) for v in one["fat"]] + [("pack", v) for v in one["pack"]]
        if with_brand and words and (brand := self._brand(words)):
            found.append(("brand", brand[0].lower()))
            words_left = brand[1].split()
        else:
            words_left = words
        return self._query(" ".join(words_left or words), tuple(found), tuple(words), context or [], type_filter)

    def from_short_name(self, sqn: str, context: list[str] | None = None) -> search.ProductQuery:
        return self._query(sqn.lower(), (), tuple(sqn.lower().split()), context or [], None)

    def from_product(self, product: dict) -> search.ProductQuery:
        """Of a product's own values: types as they are, all attribute values."""
        types = tuple((" + ".join(sorted(set(t))), len(set(t))) for t in product.get("types") or ())
        listed = [(k, v) for k in ("weight", "fat", "pack") for v in product.get(k) or ()]
        brand = [("brand", product["brand"].lower())] if product.get("brand") else []
        query = self._query(product.get("sqn") or "", tuple(listed + brand), tuple((product.get("sqn") or "").split()), product.get("tags") or [], None)
        return replace(query, types=types or query.types)

    def _brand(self, words: list[str]) -> tuple[str, str] | None:
        asked = self.spark.createDataFrame([(0, words)], "query_id int, words array<string>")
        row = search.find_brands(self.brand_index, asked).orderBy("name").first()
        return (row["name"], row["not_matched"]) if row else None

    def _query(self, sqn: str, found: tuple, words: tuple, context: list[str], type_filter: Callable[[list[str]], bool] | None) -> search.ProductQuery:
        tuples = self.terms.type_tuples(sqn, [c.strip().lower() for c in context if c.strip()])
        kept = [t for t in tuples if type_filter is None or type_filter(list(t))]
        forms = {tuple(sorted(set(self.terms.main_forms(list(t))))) for t in kept}
        tail = self.terms.tail(sqn, [list(t) for t in kept], [*parse(sqn), *context])
        return search.ProductQuery(types=tuple((" + ".join(f), len(f)) for f in sorted(forms)), attributes=found, tail=tuple(tail), words=words)

    def term_context(self, sqn: str, tags: list[str], types: list[list[str]] | None = None) -> list[str]:
        """Terms of the short name first, then tags, then the types' terms."""
        return list(dict.fromkeys([*parse(sqn), *(t.strip().lower() for t in tags if t.strip()), *(x for t in types or [] for x in t)]))

    # -- searches

    def parsed(self, name: str | list | search.ProductQuery) -> search.ProductQuery:
        """A query as it is, the words of a token list, or a text that is parsed; an empty text asks for nothing."""
        if isinstance(name, search.ProductQuery):
            return name
        words = name if isinstance(name, str) else " ".join(name)
        return self.from_name(words) if words.strip() else search.ProductQuery()

    def find_products(self, name: str | list | search.ProductQuery, limit: int | None = search.DEFAULT_LIMIT, fields: tuple[str, ...] = ()) -> ResultSet:
        query = self.parsed(name)
        # text fields hold stems: what the query asks of them is put in the same form
        stems = tuple(dict.fromkeys(s for w in query.words for s in morphology.analyzed(w)[:1]))
        tails = tuple(dict.fromkeys(s for w in query.tail for s in morphology.analyzed(w)))
        hits = search.find_products(self.index, replace(query, words=stems, tail=tails))
        rows = search.top(hits.join(self.docs, "doc_id"), limit)
        asked = tuple(dict.fromkeys(query.words))
        types = [r["term"] for r in search.known_types(query, self.index).collect()]  # a query's own, few types
        known = {w for t in types for w in t.split(" + ")} | {w for _, v in query.attributes for w in v.split()}
        matched = tuple(w for w in asked if w in known or self.terms.resolve(w, list(asked))[0] in known)
        return ResultSet(query, hits, rows.select("doc_id", "score", *fields) if fields else rows, self.docs, matched, asked)

    def find_brands(self, name: str, group_limit: int | None = 1, by_brand: bool = False) -> ResultSet:
        words = [x[4] for x in DEFAULT.items(name) if x[3] == "word"]
        asked = self.spark.createDataFrame([(0, words)], "query_id int, words array<string>")
        hits = search.find_brands(self.brand_index, asked, group_limit, by_brand).withColumn("doc_id", F.col("name"))
        return ResultSet(name, hits, hits.orderBy(F.desc("score"), "name"), self.registry.withColumn("doc_id", F.col("name")), (), tuple(words))

    # -- answers for a web page

    def suggest(self, name: str, limit: int = search.DEFAULT_LIMIT) -> str:
        """JSON: names of the first products."""
        return json.dumps([r["doc_id"] for r in self.find_products(name, limit, ("pfqn",)).rows.collect()], ensure_ascii=False)

    def summary(self, name: str) -> str:
        """JSON: what a name was parsed to."""
        q = self.from_name(name)
        return json.dumps({"types": [t for t, _ in q.types], "attributes": q.attributes, "words": q.words, "tail": q.tail, "in_context": [t for t in parse(" ".join(q.words)) if self.terms.kind(t) == CONTEXT]}, ensure_ascii=False)

