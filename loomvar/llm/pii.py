"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame functions alone.

Base spans come from fixed patterns. What they match are the protected entities: each value (cards and phones by their digits)
and, for addresses, what they belong to: the host of an email address, the network (first three parts) of an ip address. For
the words of an entity's texts, wherever they stand, corpus counts give the point-wise mutual information of word and entity;
divided by the information content of the entity, -log p(entity), it says which share of the entity's information the word
reveals. A word that shares at least MIN_SUPPORT different texts with an entity and reveals at least GENERALISE of it is, at
each of its occurrences in the texts with that entity, a span of kind `term`, to be generalised; from REMOVE on it is a span of
kind `drop`, to be removed. Texts without the entity keep the word. All counts are counts of different texts.

Plan: one pass over the texts finds spans (a table in the shared folder, with the texts that have spans); a second pass
counts words, for which each different text is shuffled once, with partial aggregation before every shuffle; the joins are on
words, entities and document keys. Nothing is collected. Frequent words and entities are aggregated before they are shuffled,
and joined from tables that the adaptive planner can split. Places in a text are running sums of the lengths of matches and
gaps, taken by chunks, so that n matches in a text take n times the root of n steps.

Nulls: a null text is empty and has no spans. Repeated rows are scanned each and count once. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvar.llm.common import gathered, stored

KINDS = ("email", "ip", "card", "phone")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "drop": ""}
#: As Java patterns that never take a step back over a run: possessive, and anchored at the start of a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match has at least; cheaper than the pattern.
HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": lambda t: t.contains("+")}
WORD = r"\p{L}{3,}+"
MIN_SUPPORT, GENERALISE, REMOVE = 3, 0.6, 0.95
#: Code points and UTF-8 bytes, ends exclusive.
SPAN = "array<struct<kind:string,start:int,end:int,bstart:int,bend:int>>"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op, zero: Column, kind: str) -> Column:
    """The running results of `op` over an array of `kind`: within chunks of about the root of its size, then over chunks."""
    none = F.array().cast(f"array<{kind}>")

    def step(acc: Column, x: Column) -> Column:
        at = op(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    each = lambda a: F.aggregate(a, F.struct(zero.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def joined_(chunks: Column) -> Column:
        before = each(F.transform(chunks, lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), zero)))
        return let(before, lambda t: F.flatten(F.transform(chunks, lambda c, k: F.when(k == 0, c).otherwise(F.transform(c, lambda x: op(F.get(t, k - 1), x))))))

    def cut(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return let(F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), size), lambda k: each(F.slice(v, k, size))), joined_)

    return F.when(F.size(values) > 0, let(values, cut)).otherwise(none)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, bstart, word>> of the leftmost matches; start counts code points, bstart bytes, both from 0."""
    length = lambda x: F.struct(F.length(x).alias("n"), F.octet_length(x).alias("b"))
    add = lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), (x["b"] + y["b"]).alias("b"))
    gaps = F.transform(F.split(text, pattern, -1), length)

    def placed(found: Column) -> Column:
        sizes = F.slice(F.zip_with(gaps, F.transform(found, length), add), 1, F.size(found))
        ends = running(sizes, add, F.struct(F.lit(0).alias("n"), F.lit(0).alias("b")), "struct<n:int,b:int>")
        return F.zip_with(ends, found, lambda e, w: F.struct((e["n"] - F.length(w)).alias("start"), (e["b"] - F.octet_length(w)).alias("bstart"), w.alias("word")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def valid(kind: str, word: Column) -> Column:
    digits = F.regexp_replace(word, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(word, r"\."), lambda p: F.coalesce(F.try_to_number(F.right(F.concat(F.lit("0000"), F.regexp_replace(p, "^0+", "")), F.lit(4)), F.lit("9999")), F.lit(0)) + F.when(F.length(F.regexp_replace(p, "^0+", "")) > 3, 1000).otherwise(0) <= 255)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    # Luhn: from the right, every second digit is doubled, less 9 if that has two digits
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.length(digits).between(16, 19) & (F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0)


def entities(kind: str, word: Column) -> Column:
    """What a match stands for: the value, and for addresses what it belongs to."""
    low = F.lower(word)
    if kind == "email":
        return F.array(F.concat(F.lit("email:"), low), F.concat(F.lit("host:"), F.substring_index(low, "@", -1)))
    if kind == "ip":
        return F.array(F.concat(F.lit("ip:"), low), F.concat(F.lit("net:"), F.substring_index(low, ".", 3)))
    return F.array(F.concat(F.lit(f"{kind}:"), F.regexp_replace(word, "[^0-9]", "")))


FOUND = "array<struct<kind:string,start:int,end:int,bstart:int,bend:int,entities:array<string>>>"


def spans_of(text: Column, kind: str) -> Column:
    ok = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["word"]))
    spans = F.transform(ok, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["word"])).alias("end"), m["bstart"].alias("bstart"), (m["bstart"] + F.octet_length(m["word"])).alias("bend"), entities(kind, m["word"]).alias("entities")))
    return F.when(HINTS[kind](text), spans.cast(FOUND)).otherwise(F.array().cast(FOUND))


def folded(word: Column) -> Column:
    return F.lower(word)


def terms_of(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"\P{L}++"), lambda w: F.length(w) >= 3), folded))


def entities_of(found: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(found, lambda s: s["entities"])))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, found: spans of all kinds with entity, by kind as listed, then start; text, where there are spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text.alias("text"))
    base = base.withColumn("found", F.concat(*[spans_of(F.col("text"), k) for k in KINDS]))
    return base.select("doc_id", "text_hash", "found", F.when(F.size("found") > 0, F.col("text")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(term, n_term): in how many different texts a word is."""
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")).dropDuplicates(["text_hash"])
    return texts.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, strength) of words that reveal at least GENERALISE of an entity."""
    some = found.where(F.size("found") > 0)
    each = some.select("text_hash", F.explode(entities_of(F.col("found"))).alias("entity")).distinct()
    texts = stored(gathered(each.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= MIN_SUPPORT)), "pii-entities")
    # the words of a text once, however many copies it has, and only then beside its entities
    words = some.select("text_hash", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    together = words.join(each.join(texts.select("entity"), "entity"), "text_hash").groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    together = stored(together.where(F.col("n_both") >= MIN_SUPPORT), "pii-terms")
    terms = stored(gathered(together.select("term").distinct()), "pii-vocabulary")
    if not terms.limit(1).count():
        return together.select("entity", "term", F.lit(0.0).alias("strength")).where("false")
    total = found.select("text_hash").distinct().count()
    # counted for the whole vocabulary first: a join below the aggregation would pass every occurrence of a term
    counted = word_counts(docs).join(terms.withColumn("asked", F.lit(True)), "term").drop("asked")
    pairs = together.join(stored(gathered(counted), "pii-counts"), "term").join(texts, "entity")
    # all four count different texts
    ratio = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    strength = F.when(F.col("n_entity") < total, ratio / F.log(F.lit(float(total)) / F.col("n_entity"))).otherwise(0.0)
    return pairs.withColumn("strength", strength).where(F.col("strength") >= GENERALISE).select("entity", "term", "strength")


def occurrences(text: Column, told: Column, base: Column) -> Column:
    """Spans of the words of a text that the map `told` (word to kind) has and that overlap no base span; by kind, then start."""
    known = F.filter(matches(text, WORD), lambda m: F.try_element_at(told, folded(m["word"])).isNotNull())
    spans = F.transform(known, lambda m: F.struct(F.try_element_at(told, folded(m["word"])).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["word"])).alias("end"), m["bstart"].alias("bstart"), (m["bstart"] + F.octet_length(m["word"])).alias("bend")))
    return F.array_sort(F.filter(spans, lambda x: ~F.exists(base, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))).cast(SPAN))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base, spans: SPAN arrays by kind as listed, then start; one row per document."""
    found = stored(find(docs), "pii-found")
    told = stored(gathered(disclosing(found, docs)), "pii-disclosing")
    some, same = found.where(F.size("found") > 0), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    entities = some.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.explode(entities_of(F.col("found"))).alias("entity")).join(told.select("entity").distinct(), "entity").distinct()
    words = some.select("doc_id", "text_hash", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    hit = words.join(entities, same).drop("id", "hash").join(told, ["entity", "term"]).groupBy("doc_id", "text_hash", "term").agg(F.max("strength").alias("strength"))
    mark = F.struct("term", F.when(F.col("strength") >= REMOVE, "drop").otherwise("term").alias("kind"))
    right = stored(hit.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.map_from_entries(F.collect_list(mark)).alias("told")), "pii-told")
    plain = F.transform("found", lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "bstart", "bend")))).cast(SPAN)
    both = found.select("doc_id", "text_hash", "text", plain.alias("base")).join(right, same, "left")
    added = F.when(F.col("told").isNotNull(), occurrences(F.col("text"), F.col("told"), F.col("base"))).otherwise(F.array().cast(SPAN))
    return both.select("doc_id", "text_hash", "base", F.concat("base", added).alias("spans"))


def joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span put out; of overlapping spans the first counts, and a later one only for what it adds."""
    raw = F.encode(text, "UTF-8")
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["bstart"].alias("start"), s["bend"].alias("end"), s["kind"].alias("kind"))))
    mask = lambda kind: F.coalesce(*[F.when(kind == k, m) for k, m in MASKS.items()])
    piece = lambda a, b: F.decode(F.substr(raw, a + 1, F.greatest(b - a, F.lit(0))), "UTF-8")

    def cut(o: Column) -> Column:
        # how far the spans up to each one reach, and those before it
        reach = running(F.transform(o, lambda s: s["end"]), F.greatest, F.lit(0), "int")
        return let(reach, lambda r: F.concat(F.array_join(F.zip_with(F.concat(F.array(F.lit(0)), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))), o, lambda before, s: F.concat(piece(before, s["start"]), F.when(s["start"] >= before, mask(s["kind"])).otherwise(""))), ""), piece(F.element_at(r, -1), F.octet_length(text))))

    return F.when(F.size(spans) > 0, let(order, cut)).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with base spans masked and disclosing words generalised or removed; all columns stay, n_chars follows."""
    marked = scan(docs).where(F.size("spans") > 0).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans_")).withColumnsRenamed({"doc_id": "id_", "text_hash": "hash_"})
    spans = stored(gathered(marked), "pii-spans")
    both = docs.join(spans, docs["doc_id"].eqNullSafe(spans["id_"]) & (F.xxhash64(docs["text"]) == spans["hash_"]), "left")
    plain = spans["spans_"].isNull()
    text = F.when(plain, docs["text"]).otherwise(masked(docs["text"], spans["spans_"]))
    changed = {"text": text.alias("text"), "n_chars": F.when(plain, docs["n_chars"]).otherwise(F.length(text).cast("long")).alias("n_chars")} if "n_chars" in docs.columns else {"text": text.alias("text")}
    return both.select(*[changed.get(c, docs[c]) for c in docs.columns])
