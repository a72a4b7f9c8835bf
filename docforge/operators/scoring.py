"""The stricter rules of answers: abstention by lines and sentences, options with guards, golden sets.

Texts are folded (NFKC, casefold) once, by the caller's choice of column (``functions.text.folded``); all rules after that are
column expressions. Where a morphological analyser is missing, words without endings and particles take its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions.text import once
from docforge.operators import evaluation as E

# Phrases of answers that decline, how they begin, what makes an answer firm, and what is no content.
CORE_PHRASE = "확인할 수 없습니다"
WHOLE_PHRASE = "제공된 문서에서 확인할 수 없습니다"
LINE_FILL = r"[\s.,:;\-·※]+"
SUBSTANCE_FROM = 15
DECLINES = (
    r"(?i)알\s*수\s*없|확인\s*(?:(?:할\s*수)?\s*없|되지\s*않)|판단\s*(?:을\s*)?(?:해\s*드릴\s*)?(?:할\s*수|수)?\s*없|판정\s*(?:을\s*)?(?:해\s*드릴\s*)?(?:할\s*수|수)?\s*없|"
    r"확정\s*(?:할\s*수)?\s*없|계산\s*(?:할\s*수)?\s*없|예측\s*(?:할\s*수)?\s*없|제공\s*(?:(?:할\s*수)?\s*없|되지\s*않)|수행\s*(?:할\s*수)?\s*없|답변\s*(?:할\s*수)?\s*없|"
    r"명시\s*(?:되어\s*)?(?:있지\s*않|되지\s*않)|정보(?:가|는)?\s*없|자료(?:가|는)?\s*없|불가능"
)
DECLINES_FIRST = r"(?i)^\s*(?:확인\s*(?:되지\s*않|할\s*수\s*없)|알\s*수\s*없|판단\s*(?:할\s*수)?\s*없|판정\s*(?:할\s*수)?\s*없)"
FIRM = r"(?i)(?:따라서|그러므로|결론적으로)?[^.!?\n]{0,50}(?:낮|높|가능|불가능|충족|미충족)[^.!?\n]{0,12}(?:습니다|입니다|합니다|된다|이다)"
TRAILING_SOURCE = r"(?is)(?:\n|\s)+(?:\[?\s*(?:근거(?:\s*문서)?|출처)\s*[:：]).*$"
FILE_IN_BRACKETS = r"(?i)\([^)]*\.(?:hwp|hwpx|pdf|docx?)[^)]*\)"
SENTENCE_END = "[.!?。！？\n]+"
QUANTITY = r"\d[\d,.]*\s*(?:원|억|만|%|개월|일)"
NO_CONTENT, CONTENT = "[^0-9a-z가-힣%]+", "[0-9a-z가-힣%]+"
FULL_DATE = r"(20\d{2})\s*(?:년|[./-])\s*(\d{1,2})\s*(?:월|[./-])\s*(\d{1,2})\s*일?"
ENDINGS = r"(?<=.)(?:입니다|이다|한다|된다|있다|없다|이며|해야|까지|부터)$"
PARTICLE = r"(?:은|는|이|가|을|를|에|의|와|과|로|으로)$"
COMPARATORS = r"이상|이하|초과|미만"
OPPOSITES = (("참여가능", "참여불가능"), ("참가가능", "참가불가능"), ("포함", "미포함"), ("충족", "미충족"))
ABSTAINING = ("abstain", "source_conflict")
PREDICTED = ("returned_document_ids", "document_ids", "returned_documents", "answer_documents", "source_documents", "retrieved_doc_ids")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def content(folded: Column) -> Column:
    """Digits, Latin and Hangul letters and percent signs of a folded text."""
    return F.array_join(_all(_text(folded), CONTENT), "")  # a fourth of the time of replacing all that lies between


# --- whether an answer declines ---------------------------------------------------------------------------------


def declines_by_lines(answer: Column) -> Column:
    """Whether an answer declines as a whole: it has the phrase, and no line holds much besides. A missing answer declines."""
    body = _stripped(F.regexp_replace(_text(answer), E.CITATION_AT_END, ""))
    rest = lambda line: F.regexp_replace(F.replace(F.replace(line, F.lit(WHOLE_PHRASE), F.lit("")), F.lit(CORE_PHRASE), F.lit("")), LINE_FILL, "")
    whole = F.contains(body, F.lit(CORE_PHRASE)) & ~F.exists(F.split(body, r"\r\n|\n|\r"), lambda line: F.char_length(rest(line)) >= SUBSTANCE_FROM)
    return F.when(answer.isNull(), True).otherwise(whole)


def _declined_body(answer: Column) -> Column:
    return _stripped(F.regexp_replace(_text(answer), E.CITATION_AT_END, ""))


def response_status(answer: Column, error: Column) -> Column:
    """execution_error, empty_response, answered, partial_answer or abstained, sentence by sentence.

    A sentence that declines counts as content where it names an amount, a share or a span of time; another one where
    it has a digit or enough characters. Sources at the end and file names in brackets are left out first.
    """
    body = F.regexp_replace(_stripped(F.regexp_replace(_declined_body(answer), TRAILING_SOURCE, "")), FILE_IN_BRACKETS, " ")

    def substantial(sentence: Column) -> Column:
        amount = F.regexp_replace(F.regexp_replace(sentence, DECLINES, " "), r"\([^)]*\)", " ").rlike(QUANTITY)
        plain = content(F.lower(sentence))
        return F.when(sentence.rlike(DECLINES), amount).otherwise(plain.rlike(r"\d") | (F.char_length(plain) >= SUBSTANCE_FROM))

    return (
        F.when(_stripped(_text(error)) != "", "execution_error")
        .when(_stripped(_text(answer)) == "", "empty_response")
        .when(~body.rlike(DECLINES), "answered")
        .when(F.exists(F.split(body, SENTENCE_END), substantial), "partial_answer")
        .otherwise("abstained")
    )


def response_status_leading(answer: Column, error: Column) -> Column:
    """As ``response_status``, but an answer that declines at its beginning and makes no firm statement after that has abstained."""
    body = _declined_body(answer)
    quiet = body.rlike(DECLINES_FIRST) & ~F.regexp_replace(body, DECLINES_FIRST, "").rlike(FIRM)
    usable = (_stripped(_text(error)) == "") & (_stripped(_text(answer)) != "")
    return F.when(usable & quiet, "abstained").otherwise(response_status(answer, error))


# --- whether an answer states an option -------------------------------------------------------------------------


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _bare(number: Column) -> Column:
    plain = F.regexp_replace(number, "^0+", "")
    return F.when(plain == "", "0").otherwise(plain)


def number_keys(folded: Column) -> Column:
    return F.transform(_all(F.replace(_text(folded), F.lit(","), F.lit("")), r"\d+(?:\.\d+)?"), _bare)


def date_keys(folded: Column) -> Column:
    part = lambda d, k, n: F.lpad(F.regexp_extract(d, FULL_DATE, k), n, "0")
    return F.transform(_all(_text(folded), FULL_DATE), lambda d: F.concat(part(d, 1, 4), part(d, 2, 2), part(d, 3, 2)))


def within_set(a: Column, b: Column) -> Column:
    """Whether all of one array are in the other."""
    return F.size(F.array_except(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def with_missing(a: Column, b: Column) -> Column:
    """An array with those of another that it lacks, at its end."""
    return F.array_union(a, b)


def words_of(folded: Column) -> Column:
    """Words of two characters or more that do not begin with a digit, without endings and particles."""
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, ENDINGS, ""), PARTICLE, "")
    words = F.filter(_all(_text(folded), "[0-9a-z가-힣%]+"), lambda w: ~w.rlike(r"^\d"))
    return F.filter(F.transform(words, bare), lambda w: F.char_length(w) >= 2)


def states_option(answer: Column, option: Column, share: float = 0.4) -> Column:
    """Of folded texts: the option is inside, or its dates and long numbers are there and enough of its words occur.

    Both texts are folded to content once, not for each word; dates and numbers of an answer are read only for an option that has some.
    """

    def sides(x: Column) -> Column:
        numbers = F.filter(number_keys(x["option"]), lambda n: F.char_length(n) >= 2)
        values = {"answer": x["answer"], "have": content(x["answer"]), "want": content(x["option"]), "dates": date_keys(x["option"]), "numbers": numbers, "words": words_of(x["option"])}
        return once(judged, **values)

    def judged(x: Column) -> Column:
        dates, numbers, words = x["dates"], x["numbers"], x["words"]
        kept = ((F.size(dates) == 0) | within_set(dates, date_keys(x["answer"]))) & ((F.size(numbers) == 0) | within_set(numbers, number_keys(x["answer"])))
        met = F.size(F.filter(words, lambda w: F.contains(x["have"], w)))
        enough = F.when(F.size(words) > 0, met / F.size(words) >= share).otherwise((F.size(dates) > 0) | (F.size(numbers) > 0))
        return ((x["want"] != "") & F.contains(x["have"], x["want"])) | (kept & enough)

    return once(sides, answer=answer, option=option)


def same_terms(folded: Column) -> Column:
    """Notations that mean the same as one: parts of a hundred, the currency after a unit, whether one may take part."""
    out = F.regexp_replace(_text(folded), r"100\s*분의\s*(\d+(?:\.\d+)?)", "$1%")
    out = F.regexp_replace(out, r"(\d+(?:\.\d+)?\s*(?:조|억|만|천))\s*원", "$1")
    out = F.regexp_replace(out, r"(참여|참가)\s*(?:할\s*)?수\s*없(?:습니다|다|음)?", "$1 불가능")
    return F.regexp_replace(out, r"(참여|참가)\s*(?:할\s*)?수\s*있(?:습니다|다|음)?", "$1 가능")


def states_option_strictly(answer: Column, option: Column, share: float = 1.0, words=words_of) -> Column:
    """Of folded texts: no opposite stated, comparators, numbers, shares and amounts all there; then as ``states_option`` or by words.

    ``words``: a column function from a folded text to its words; a morphological analyser may take its place.
    """
    a, o = same_terms(answer), same_terms(option)
    close = lambda c: F.regexp_replace(c, r"\s+", "")
    against = F.lit(False)
    for good, bad in OPPOSITES:
        against = against | (F.contains(close(o), F.lit(good)) & F.contains(close(a), F.lit(bad)))
    percent = lambda c: F.transform(_all(F.replace(c, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)\s*%", 1), _bare)
    money = lambda c: F.transform(_all(F.replace(c, F.lit(","), F.lit("")), r"\d+(?:\.\d+)?\s*(?:조|억|만|천)"), lambda m: F.concat(_bare(F.regexp_extract(m, r"\d+(?:\.\d+)?", 0)), F.substring(m, -1, 1)))
    kept = within_set(_all(o, COMPARATORS), _all(a, COMPARATORS)) & within_set(number_keys(o), number_keys(a)) & within_set(percent(o), percent(a)) & within_set(money(o), money(a))
    # words may come from Python, which has no place within a lambda
    met = F.get(F.transform(F.array(F.struct(words(o).alias("need"), words(a).alias("have"))), lambda x: F.size(F.filter(x["need"], lambda w: F.array_contains(x["have"], w))) / F.nullif(F.size(x["need"]), F.lit(0))), F.lit(0))
    by_words = F.when(met.isNotNull(), met >= share)
    return ~against & kept & (states_option(a, o) | by_words.otherwise((F.size(percent(o)) > 0) | (F.size(money(o)) > 0) | (F.size(date_keys(o)) > 0)))


def stated_groups(answer: Column, groups: Column, matches=states_option_strictly) -> Column:
    """Share of groups of variants with a variant that the folded answer states; null without groups."""
    met = F.size(F.filter(groups, lambda g: F.exists(g, lambda v: matches(answer, v))))
    return F.when(F.size(groups) > 0, met / F.size(groups))


# --- golden sets ------------------------------------------------------------------------------------------------


def _filled(groups: Column) -> Column:
    """Groups without blank variants; groups that had nothing else go."""
    return F.filter(F.transform(groups, lambda g: F.filter(g, lambda v: _stripped(_text(v)) != "")), lambda g: F.size(g) > 0)


def fact_groups(key_points: Column, groups: Column, facts: Column) -> Column:
    """Groups of variants: key points (arrays of variants) where there are any, else fact groups, else single facts."""
    none = F.expr("cast(array() as array<array<string>>)")
    single = F.transform(facts, lambda f: F.array(f))
    return F.coalesce(F.when(F.size(key_points) > 0, _filled(key_points)), F.when(F.size(groups) > 0, _filled(groups)), F.when(F.size(facts) > 0, _filled(single)), none)


def expected_decision(gold: Column, own: Column, capability: Column) -> Column:
    """The decision of the gold record, else the case's own, else by its capability."""
    said = lambda c: F.nullif(F.lower(_stripped(_text(c))), F.lit(""))
    return F.coalesce(said(gold), said(own), F.when(F.lower(_text(capability)) == "abstain", "abstain").otherwise("answer"))


def document_set(values: Column) -> Column:
    """Sorted folded names, without tables of data and blank ones."""
    names = F.filter(values, lambda v: ~F.lower(v).rlike(r"(?<=[^/])\.csv$"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda v: content(F.lower(v))), lambda v: v != "")))


def first_document_set(*sources: Column) -> Column:
    """The document set of the first source that gives one."""
    return F.coalesce(*[F.when(F.size(document_set(s)) > 0, document_set(s)) for s in sources], F.expr("cast(array() as array<string>)"))


def remapped(cases: DataFrame, duplicates: DataFrame, key: str, sources: str) -> DataFrame:
    """Cases with excluded documents replaced by those they repeat, in order and each once. Empty and null lists stay."""
    one = duplicates.groupBy(F.col("doc_id").alias("_s")).agg(F.min("dup_of").alias("_to"))
    each = cases.select(key, F.posexplode(sources).alias("_at", "_s")).join(one, "_s", "left").select(key, "_at", F.coalesce("_to", "_s").alias("_s"))
    made = each.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda x: x["_s"])).alias("_new"))
    return cases.join(made, key, "left").withColumn(sources, F.coalesce("_new", sources)).drop("_new")


def with_predictions(cases: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every case with its prediction; a case without one has an empty answer, so its status is empty_response."""
    out = cases.join(predictions, key, "left")
    return out.withColumn("status", response_status_leading(F.col("answer"), F.col("execution_error")))


def overlaid(cases: DataFrame, patch: DataFrame, key: str, documents: str) -> DataFrame:
    """Cases with the documents that a patch (key, documents, n_expected) adds; a case that has another number after that raises an error."""
    more = patch.select(key, F.col(documents).alias("_more"), F.col("n_expected").alias("_n"))
    out = cases.join(more, key, "left").withColumn(documents, F.when(F.col("_more").isNull(), F.col(documents)).otherwise(with_missing(F.col(documents), F.col("_more"))))
    bad = F.concat(F.lit("unexpected number of documents in case "), F.col(key).cast("string"))
    checked = F.when(F.col("_n").isNull() | (F.size(documents) == F.col("_n")), F.col(documents)).otherwise(F.raise_error(bad))
    return out.withColumn(documents, checked).drop("_more", "_n")


def rescored(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cases whose scores changed, with both values; null equals null."""
    both = old.select(key, *[F.col(c).alias(f"old_{c}") for c in columns]).join(new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns]), key)
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return both.where(changed)


def inspected(hits: DataFrame, expected: DataFrame, query_key: str = "query_id", key: str = "doc_id", top: int = 5) -> DataFrame:
    """The first hits of each query with a flag for those that were expected."""
    wanted = expected.select(query_key, key).distinct().withColumn("expected", F.lit(True))
    return hits.where(F.col("rank") <= top).join(wanted, [query_key, key], "left").withColumn("expected", F.coalesce("expected", F.lit(False)))
