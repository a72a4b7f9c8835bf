"""Which chunks a question is answered from: document hints, keyword chunks, visual evidence, anchors of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import names as names_in
from docforge.operators.retrieval import first_per_group, tokens

# How many chunks each route takes.
KEYWORD_CHUNKS, LEADING_CHUNKS, PER_HINT, SINGLE_HINT, PER_CONDITION = 20, 10, 8, 15, 3
LATIN_WEIGHT = 3
SLICE, SLICE_LEAST = 50, 8


# Words of owners that are too common for a piece of a name, and what is left out of a name.
COMMON_OWNER_WORDS = ("박물관", "시스템", "센터", "공단", "진흥원", "협회", "재단", "연구원", "공사", "대학교", "사업", "관리", "운영", "구축", "개선", "개발", "지원", "정보", "용역", "기관", "기술", "고도화", "확대", "기능", "서비스")
OWNER_NOISE, OWNER_RANK = r"\([^)]*\)|\s*입찰공고\s*$", "특별시|광역시|특별자치시|특별자치도"


def owner_names(catalogue: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(owner, name): what an owner is called in lower case without blanks: its name, that without its rank, and its ``aliases`` (owner, alias)."""
    core = F.regexp_replace(F.lower("owner"), OWNER_NOISE, "")
    own = catalogue.select("owner", T.squeezed(core).alias("name")).distinct()
    short = own.select("owner", F.regexp_replace("name", OWNER_RANK, "").alias("name")).where(F.length("name") >= 3)
    out = own.where(F.length("name") >= 2).union(short)
    if aliases is not None:
        out = out.union(aliases.join(own.select("owner"), "owner", "left_semi").select("owner", T.squeezed(F.lower("alias")).alias("name")))
    return out.distinct()


def hint_scores(questions: DataFrame, catalogue: DataFrame, aliases: DataFrame | None = None, common: tuple[str, ...] = COMMON_OWNER_WORDS) -> DataFrame:
    """(query_id, doc_id, score) of documents that a question names.

    ``catalogue`` has doc_id, owner, title; ``aliases`` (owner, alias) says what else owners are called. A question names
    a document by its owner (20), by six characters of the owner in a row without a ``common`` word (10), by its title of
    more than 3 characters (30), or by words of the title (1, Latin ones 3); a score is 3 at least. Names and questions meet
    by pieces of names, words by themselves, so each side is shuffled once and no pair is made that shares nothing.
    """
    q = questions.select("query_id", T.squeezed(F.lower("text")).alias("_q"), tokens(F.col("text")).alias("_qw"))
    names = owner_names(catalogue, aliases)
    owners = catalogue.select("doc_id", "owner")
    full = names_in.contained(q, names, "query_id", "_q", "owner", "name").select("query_id", "owner", F.lit(20).alias("points"))
    part = names_in.touched(q, names, "query_id", "_q", "owner", "name", common=common).select("query_id", "owner", F.lit(10).alias("points"))
    by_owner = full.union(part).groupBy("query_id", "owner").agg(F.max("points").alias("points")).join(owners, "owner").select("query_id", "doc_id", "points")
    titles = catalogue.select("doc_id", T.squeezed(F.lower("title")).alias("_t")).where(F.length("_t") > 3)
    by_title = names_in.contained(q, titles, "query_id", "_q", "doc_id", "_t").select("query_id", "doc_id", F.lit(30).alias("points"))
    words = catalogue.select("doc_id", F.explode(F.array_distinct(tokens(F.col("title")))).alias("word"))
    asked = q.select("query_id", F.explode(F.array_distinct("_qw")).alias("word"))
    by_word = asked.join(words, "word").groupBy("query_id", "doc_id").agg(F.sum(F.when(F.col("word").rlike("[a-z]"), LATIN_WEIGHT).otherwise(1)).cast("int").alias("points"))
    return by_owner.union(by_title).union(by_word).groupBy("query_id", "doc_id").agg(F.sum("points").alias("score")).where("score >= 3")


def best_hints(scores: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The best document of each owner for each question."""
    own = scores.join(catalogue.select("doc_id", "owner"), "doc_id")
    return own.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "owner").orderBy(F.desc("score"), "doc_id"))).where("_r = 1").drop("_r")


def routed_chunks(hints: DataFrame, chunks: DataFrame, keywords: DataFrame) -> DataFrame:
    """Chunks for each question: several hinted documents give their first 8 each; one gives keyword chunks and its first ones.

    ``hints``: (query_id, doc_id); ``keywords``: (query_id, words); ``chunks``: (doc_id, chunk_id, nth, text).
    """
    n = hints.groupBy("query_id").agg(F.count("*").alias("n_hints"))
    own = hints.join(n, "query_id").join(chunks, "doc_id").join(keywords, "query_id", "left")
    hit = F.exists(F.coalesce("words", F.expr("cast(array() as array<string>)")), lambda w: F.contains(F.lower("text"), F.lower(w)))
    own = own.withColumn("hit", hit)
    many = first_per_group(own.where("n_hints >= 2"), ["query_id", "doc_id"], [F.col("nth")], PER_HINT)
    one = own.where("n_hints = 1")
    asked = F.size(F.coalesce("words", F.expr("cast(array() as array<string>)"))) > 0
    by_word = first_per_group(one.where(asked & F.col("hit")), ["query_id"], [F.col("nth")], KEYWORD_CHUNKS)
    lead = first_per_group(one.where(asked), ["query_id"], [F.col("nth")], LEADING_CHUNKS)
    plain = first_per_group(one.where(~asked), ["query_id"], [F.col("nth")], SINGLE_HINT)
    out = many.unionByName(by_word).unionByName(lead).unionByName(plain)
    return out.select("query_id", "doc_id", "chunk_id", "nth", "text").dropDuplicates(["query_id", "chunk_id"])


def assembled(questions: DataFrame, hints: DataFrame, chunks: DataFrame, catalogue: DataFrame, conditioned: DataFrame, searched: DataFrame) -> DataFrame:
    """(query_id, route, doc_id, chunk_id, place): the chunks that a question is answered from, by the first route that fits.

    ``questions``: (query_id, words, aggregates); ``hints``: (query_id, doc_id, nth), the named documents in order;
    ``chunks``: (doc_id, chunk_id, nth); ``text`` of chunks is searched for ``words``; ``catalogue``: (doc_id, owner);
    ``conditioned``: (query_id, doc_id) of documents that fit a question's conditions; ``searched``: (query_id, doc_id,
    chunk_id, rank) of a search for all questions.

    - all: a question that aggregates and names documents gets all chunks of the one whose id or owner has most of its
      words, the first on ties;
    - words: one named document and words: its first 20 chunks with a word and its first 10;
    - several: of each named document the first 8 chunks with a word, or without any hit its first 8;
    - document: one named document without words: its first 15;
    - conditions: no named document: the first 3 of each that fits;
    - search: else, and for "words" without a hit, what the search found.

    ``place`` orders the chunks of a question from 1. Chunks are ranked within one document of one question.
    """
    words = F.coalesce("words", F.expr("cast(array() as array<string>)"))
    q = questions.select("query_id", words.alias("words"), F.coalesce("aggregates", F.lit(False)).alias("aggregates"))
    n = hints.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_hints"))
    fits = conditioned.select("query_id", F.lit(True).alias("fits")).distinct()
    q = q.join(n, "query_id", "left").join(fits, "query_id", "left").withColumn("n_hints", F.coalesce("n_hints", F.lit(0)))
    asked = F.size("words") > 0
    route = F.when((F.col("n_hints") > 0) & F.col("aggregates"), "all").when((F.col("n_hints") == 1) & asked, "words").when(F.col("n_hints") > 1, "several").when(F.col("n_hints") == 1, "document").when(F.col("fits"), "conditions").otherwise("search")
    q = q.withColumn("route", route)
    named = hints.groupBy("query_id", "doc_id").agg(F.min("nth").alias("hint")).join(q, "query_id").join(catalogue.select("doc_id", "owner").dropDuplicates(["doc_id"]), "doc_id", "left")
    has = lambda c: F.size(F.filter("words", lambda w: F.contains(F.col("doc_id").cast("string"), w) | F.contains(F.coalesce(c, F.lit("")), w)))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(has(F.col("owner"))), "hint", "doc_id"))
    named = named.withColumn("best", best).where("route <> 'all' or best = 1")
    fitting = conditioned.select("query_id", "doc_id").distinct().join(q.where("route = 'conditions'"), "query_id").select("query_id", "doc_id", F.lit(0).alias("hint"), "words", "route")
    own = named.select("query_id", "doc_id", "hint", "words", "route").unionByName(fitting).join(chunks, "doc_id")
    by = Window.partitionBy("query_id", "doc_id")
    own = own.withColumn("hit", F.exists("words", lambda w: F.contains("text", w)).cast("int"))
    own = own.withColumns({"hits": F.sum("hit").over(by), "hit_no": F.sum("hit").over(by.orderBy("nth", "chunk_id")), "no": F.row_number().over(by.orderBy("nth", "chunk_id"))})
    with_word = lambda most: (F.col("hit") == 1) & (F.col("hit_no") <= most)
    kept = (
        F.when(F.col("route") == "all", True).when(F.col("route") == "words", (F.col("hits") > 0) & (with_word(KEYWORD_CHUNKS) | (F.col("no") <= LEADING_CHUNKS)))
        .when(F.col("route") == "several", F.when(F.col("hits") > 0, with_word(PER_HINT)).otherwise(F.col("no") <= PER_HINT)).when(F.col("route") == "document", F.col("no") <= SINGLE_HINT).otherwise(F.col("no") <= PER_CONDITION)
    )
    # of "words" the chunks with a word stand first
    ahead = F.when((F.col("route") == "words") & ~with_word(KEYWORD_CHUNKS), 1).otherwise(0)
    picked = own.where(kept).select("query_id", "route", "doc_id", "chunk_id", F.struct(ahead.alias("a"), "hint", F.col("doc_id").cast("string").alias("d"), "no").alias("order"))
    none = q.where("route = 'words'").select("query_id").join(picked.select("query_id").distinct(), "query_id", "left_anti").union(q.where("route = 'search'").select("query_id"))
    fallback = searched.join(none, "query_id", "left_semi").select("query_id", F.lit("search").alias("route"), "doc_id", "chunk_id", F.struct(F.lit(0).alias("a"), F.col("rank").cast("int").alias("hint"), F.lit("").alias("d"), F.lit(0).alias("no")).alias("order"))
    return picked.unionByName(fallback).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("order", "chunk_id"))).drop("order")


def visual_evidence(questions: DataFrame, retrieved: DataFrame, evidence: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` pieces of evidence of retrieved documents that share most words with the question."""
    both = retrieved.join(questions, "query_id").join(evidence.where("error is null and doc_id is not null and evidence_text <> ''"), "doc_id")
    overlap = F.size(F.array_intersect(tokens(F.col("text")), tokens(F.col("evidence_text"))))
    return first_per_group(both.withColumn("overlap", overlap).where("overlap > 0"), ["query_id"], [F.desc("overlap"), F.col("evidence_id")], n)


def anchor(text: Column) -> Column:
    """Fifty characters from the inside of a candidate; null where it is too short to be told from others."""
    clean = F.trim(text)
    start = F.floor(F.greatest(F.length(clean) - SLICE, F.lit(0)) / 3).cast("int") + 1
    out = F.trim(F.substring(clean, start, F.lit(SLICE)))
    return F.when(F.length(out) >= SLICE_LEAST, out)


def candidate_contexts(candidates: DataFrame, chunks: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, context): for each candidate the first non-parent chunk with its anchor, as its parent's text; the candidates where none has.

    Chunks and candidates meet by document, so a text is only searched in chunks of its own document.
    """
    c = candidates.select("doc_id", "nth", F.col("text").alias("candidate"), anchor(F.col("text")).alias("_a"))
    own = chunks.where("strategy <> 'parent'").select("doc_id", F.col("nth").alias("c_nth"), "chunk_id", F.coalesce("parent_chunk_id", "chunk_id").alias("p_id"), F.col("text").alias("c_text"))
    found = c.join(own, "doc_id").where(F.contains("c_text", "_a")).groupBy("doc_id", "nth").agg(F.min_by("p_id", "c_nth").alias("chunk_id"))
    full = found.join(chunks.select("chunk_id", F.col("text").alias("full")), "chunk_id").groupBy("doc_id", "full").agg(F.min("nth").alias("nth"))
    kept = first_per_group(full, ["doc_id"], [F.col("nth")], n).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "full"))).alias("x"))
    raw = first_per_group(c, ["doc_id"], [F.col("nth")], n).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "candidate"))).alias("y"))
    joined = raw.join(kept, "doc_id", "left")
    text = F.when(F.col("x").isNotNull(), F.array_join(F.transform("x", lambda x: x["full"]), "\n\n")).otherwise(F.array_join(F.transform("y", lambda y: y["candidate"]), "\n\n"))
    return joined.select("doc_id", text.alias("context"), F.col("x").isNotNull().alias("from_chunks"))


def excerpt(document: Column, candidate: Column, width: int = 800) -> Column:
    """The surroundings of a candidate's head in a document whose white space is made single."""
    one = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    place = F.call_function("instr", one(document), F.substring(one(candidate), 1, 40))
    start = F.greatest(place - F.lit(width // 4), F.lit(1))
    return F.when(place > 0, F.substring(one(document), start, F.lit(width))).otherwise(F.substring(one(candidate), 1, width))


def selected_candidates(candidates: DataFrame, picks: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, candidate_id, nth, needs_final) of what was picked from batches (query_id, batch, at, candidate_id).

    Unknown candidates go, repeated ones count where they were picked first. Above ``most`` a final round compares them.
    """
    known = picks.join(candidates.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_semi")
    first = known.groupBy("query_id", "candidate_id").agg(F.min(F.struct("batch", "at")).alias("_place"))
    own = Window.partitionBy("query_id")
    return first.select("query_id", "candidate_id", (F.row_number().over(own.orderBy("_place", "candidate_id")) - 1).alias("nth"), (F.count("*").over(own) > most).alias("needs_final"))


def finalists(selected: DataFrame, final_picks: DataFrame, candidates: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, candidate_id, nth): the final picks (query_id, at, candidate_id) where a final round was needed, else what was selected."""
    again = selected.where("needs_final").select("query_id").distinct()
    final = final_picks.join(again, "query_id", "left_semi").join(candidates.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_semi")
    final = first_per_group(final, ["query_id"], [F.col("at")], most).select("query_id", "candidate_id", F.col("at").cast("int").alias("nth"))
    return selected.where("not needs_final").select("query_id", "candidate_id", "nth").union(final)


def visual_texts(read: DataFrame) -> DataFrame:
    """(query_id, evidence_text, error): what was read (query_id, nth, doc_id, page, candidate_id, evidence) in lines that name their place; ``most`` lines a query."""
    told = F.trim(F.coalesce("evidence", F.lit("")))
    line = F.concat(F.lit("["), "doc_id", F.lit(" / page="), F.coalesce(F.col("page").cast("string"), F.lit("unknown")), F.lit(" / "), "candidate_id", F.lit("] "), told)
    lines = read.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(told != "", F.struct("nth", line.alias("line"))))).alias("xs"))
    return lines.select("query_id", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("evidence_text"), F.when(F.size("xs") == 0, "no_relevant_visual_evidence_selected").alias("error"))
