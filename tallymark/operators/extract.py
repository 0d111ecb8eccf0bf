"""From tokens to fields: visual lines, label proximity, pattern fallbacks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config as C
from ..functions import addresses, dates, ids, labels, text
from ..functions.text import once
from . import classify
from .reading import ROADS, SEPARATORS, TOKEN, read_pages


def visual_lines(tokens: DataFrame, keys: list[str], gap: int = C.DEFAULT.line_gap, tiebreak: tuple[str, ...] = ("pos",)) -> DataFrame:
    """``tokens`` with ``line_no``: in reading order, a new line begins where y is ``gap`` or more off the token before."""
    w = Window.partitionBy(*keys).orderBy(F.floor(F.col("y") / 15), "x", *tiebreak)
    fresh = tokens.withColumn("_new", F.when(F.abs(F.col("y") - F.lag("y").over(w)) < gap, 0).otherwise(1))
    return fresh.withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def line_boxes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The union box, mean confidence and text (left to right) of each line."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "text"))), lambda t: t["text"])
    return lines.groupBy(*keys, "line_no").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        F.round(F.sum(F.col("conf").cast("decimal(20,6)")).cast("double") / F.count(F.lit(1)), 3).alias("conf"), F.count(F.lit(1)).alias("n_tokens"), F.array_join(words, " ").alias("text"),
    )


LABEL_OF = {re.sub(r"[^\w\s]", "", s): f for f, names in reversed(C.LABELS.items()) for s in reversed(names)}


def exact_label(c: Column) -> Column:
    """The field whose label this text is, letter for letter; null if none."""
    return F.element_at(text.lookup(LABEL_OF), F.trim(F.regexp_replace(F.lower(c), text.NOT_WORD, "")))


def label_scan(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of one to three tokens of a line that are a label: ``line_no, token_no, n, field``."""
    w = Window.partitionBy(*keys, "line_no").orderBy("x", "col")
    runs = tokens.withColumn("token_no", F.row_number().over(w)).withColumn("t2", F.lead("text", 1).over(w)).withColumn("t3", F.lead("text", 2).over(w))
    grams = F.array(F.struct(F.lit(1).alias("n"), F.col("text").alias("gram")), F.struct(F.lit(2).alias("n"), F.when(F.col("t2").isNotNull(), F.concat_ws(" ", "text", "t2")).alias("gram")), F.struct(F.lit(3).alias("n"), F.when(F.col("t3").isNotNull(), F.concat_ws(" ", "text", "t2", "t3")).alias("gram")))
    return runs.select(*keys, "line_no", "token_no", F.explode(grams).alias("g")).select(*keys, "line_no", "token_no", "g.n", "g.gram", exact_label(F.col("g.gram")).alias("field")).filter("field is not null")


def labelled(tokens: DataFrame, keys: list[str], gap: int = C.DEFAULT.line_gap, dictionary: labels.Labels = labels.DEFAULT) -> DataFrame:
    """``tokens`` (``pos`` and box) with ``line_no``, ``token_no`` in the line, and the fields ``f1, f2, f3`` whose label the one, two or three tokens
    from here on are. One shuffle by ``keys`` serves both windows; what follows may group by them without another."""
    lines = visual_lines(tokens, keys, gap)
    w = Window.partitionBy(*keys, "line_no").orderBy("x", F.floor(F.col("y") / 15), "pos")
    # a token is cleaned once, not again in each run that it stands in
    own = lines.withColumn("_1", labels.word_letters(F.col("text")))
    runs = own.withColumn("token_no", F.row_number().over(w)).withColumn("_2", F.lead("_1", 1).over(w)).withColumn("_3", F.lead("_1", 2).over(w))
    joined = runs.withColumns({"_3": F.when(F.col("_3").isNotNull(), F.trim(F.concat_ws(" ", "_1", "_2", "_3"))), "_2": F.when(F.col("_2").isNotNull(), F.trim(F.concat_ws(" ", "_1", "_2"))), "_1": F.trim("_1")})
    return joined.withColumns({f"f{n}": dictionary.match_cleaned(F.col(f"_{n}")) for n in (1, 2, 3)}).drop("_1", "_2", "_3")


def rows_of(read: Column, gap: int, dictionary: labels.Labels) -> Column:
    """The lines of ``labelled`` for one document's tokens, gathered: an array of lines, each an array of tokens from left to right with ``line_no``,
    ``token_no`` and ``f1, f2, f3``. What it costs grows with the tokens; a line is reached by its number."""
    band = lambda t: F.floor(t["y"] / 15)
    at = lambda ts, k: F.get(ts, k)["t"]["y"]

    def lines(placed: Column) -> Column:
        near = lambda k: F.coalesce(F.abs(at(placed, k) - at(placed, k - 1)) < gap, F.lit(False))
        starts = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda k: (k == 0) | ~near(k))
        own = lambda s, end: F.sort_array(F.transform(F.slice(placed, s + 1, end - s), lambda p: F.struct(p["x"].alias("x"), p["band"].alias("band"), p["pos"].alias("pos"), p["t"].alias("t"))))
        return text.let(starts, lambda ss: F.transform(ss, lambda s, k: marked(own(s, F.coalesce(F.get(ss, k + 1), F.size(placed))), k + 1)))

    def marked(line: Column, line_no: Column) -> Column:
        def token(p: Column, k: Column, words: Column) -> Column:
            one, two, three = (F.get(words, k + n) for n in range(3))
            # the runs of a token are one expression, so a plan has the dictionary once
            runs = F.array(F.trim(one), F.when(two.isNotNull(), F.trim(F.concat_ws(" ", one, two))), F.when(three.isNotNull(), F.trim(F.concat_ws(" ", one, two, three))))
            made = lambda fs: F.struct(line_no.alias("line_no"), (k + 1).alias("token_no"), p["pos"].alias("pos"), *(p["t"][c].alias(c) for c in TOKEN), *(F.get(fs, F.lit(n)).alias(f"f{n + 1}") for n in range(3)))
            return text.let(F.transform(runs, dictionary.match_cleaned), made)

        return text.let(line, lambda ts: text.let(F.transform(ts, lambda p: labels.word_letters(p["t"]["text"])), lambda words: F.transform(ts, lambda p, k: token(p, k, words))))

    return text.let(F.sort_array(F.transform(read, lambda t: F.struct(band(t).alias("band"), t["x"].alias("x"), t["pos"].alias("pos"), t.alias("t")))), lines)


def pages(tokens: DataFrame, gap: int = C.DEFAULT.line_gap, dictionary: labels.Labels = labels.DEFAULT) -> DataFrame:
    """One row a document: ``case_id, doc_id, doc_type, text, read`` (tokens in the recogniser's order) and ``lines`` (each left to right).

    ``doc_type`` is the tokens' own where they have one, else that of the text's keywords. Tokens are gathered once and then read in place.
    """
    read = F.sort_array(F.collect_list(F.struct("pos", *TOKEN)))
    kind = "doc_type" in tokens.columns
    gathered = tokens.groupBy("case_id", "doc_id").agg(read.alias("read"), *(F.first(c).alias(c) for c in ("doc_type", "doc_no") if c in tokens.columns))
    whole = once(gathered, text=F.array_join(F.transform("read", lambda t: t["text"]), " "), lines=rows_of(F.col("read"), gap, dictionary))
    return whole if kind else classify.classify(whole).drop("type_confidence", "top_2")


def _box(ts: Column) -> Column:
    """The union box as an array x, y, w, h; null for no tokens."""
    x, y = F.array_min(F.transform(ts, lambda t: t["x"])), F.array_min(F.transform(ts, lambda t: t["y"]))
    right, low = F.array_max(F.transform(ts, lambda t: t["x"] + t["w"])), F.array_max(F.transform(ts, lambda t: t["y"] + t["h"]))
    return F.when(F.size(ts) > 0, F.array(x, y, right - x, low - y))


def _conf(ts: Column, default: Column) -> Column:
    """The mean confidence to three places; ``default`` for no tokens."""
    total = F.aggregate(ts, F.lit(0).cast("decimal(18,6)"), lambda s, t: (s + t["conf"].cast("decimal(18,6)")).cast("decimal(18,6)"))  # the widest that is a long
    return F.when(F.size(ts) > 0, F.round(total.cast("double") / F.size(ts), 3)).otherwise(default)


def _joined(ts: Column) -> Column:
    return F.array_join(F.transform(ts, lambda t: t["text"]), " ")


def _plain(ts: Column) -> Column:
    return F.transform(ts, lambda t: F.struct(t["pos"].alias("pos"), *(t[c].alias(c) for c in TOKEN)))


def _found(field: Column, raw: Column, own: Column, default: float | None, method: str, around: Column) -> Column:
    """A field as it is found, before its evidence is gathered: its tokens and, should they be on no line of the recogniser's, others."""
    return F.struct(field.alias("field"), raw.alias("value_raw"), own.alias("own"), F.lit(default).cast("double").alias("default"), F.lit(method).alias("method"), around.alias("around"))


def with_evidence(found: Column, read: Column) -> Column:
    """``found`` fields with box and confidence of their tokens, and text, box and confidence of the recogniser's lines on which these are."""

    def context(x: Column) -> Column:
        on = F.array_distinct(F.filter(F.transform(x["own"], lambda t: t["line_id"]), lambda k: k.isNotNull()))
        line = text.let(on, lambda on: F.when(F.size(on) > 0, F.filter(read, lambda t: F.array_contains(on, t["line_id"]))).otherwise(x["around"]))
        ordered = F.transform(F.sort_array(F.transform(line, lambda t: F.struct(F.floor(t["y"] / 15).alias("a"), t["x"].alias("b"), t["pos"].alias("c"), t.alias("t")))), lambda s: s["t"])
        none = F.lit(None).cast("double")
        return text.let(ordered, lambda own: F.struct(F.nullif(_joined(own), F.lit("")).alias("span"), _box(own).alias("box"), _conf(own, none).alias("conf")))

    return F.transform(found, lambda x: F.struct(x["field"].alias("field"), x["value_raw"].alias("value_raw"), _conf(x["own"], x["default"]).alias("ocr_conf"), _box(x["own"]).alias("box"), x["method"].alias("method"), context(x).alias("context")))


def by_label(lines: Column) -> Column:
    """Fields found beside their labels: for each label in reading order (one token before two before three) the tokens to its right,
    else the next line, up to the next label. A label without a value leaves its field to the next one."""
    hit = lambda t: F.filter(F.array(*[F.struct(t["line_no"].alias("line_no"), (t["token_no"] + n).alias("at"), t[f"f{n}"].alias("field")) for n in (1, 2, 3)]), lambda h: h["field"].isNotNull())
    from_ = lambda ts, k: F.slice(ts, k, F.greatest(F.size(ts), F.lit(0)))

    def value(h: Column) -> Column:
        rest = from_(F.get(lines, h["line_no"] - 1), h["at"])
        below = F.get(lines, h["line_no"])

        def right(ts: Column) -> Column:
            first = F.array_position(F.transform(ts, lambda t: ~t["text"].isin(*SEPARATORS)), True).cast("int")  # from 1; 0 if none
            return text.let(first, lambda k: F.when(k > 0, from_(ts, F.greatest(k, F.lit(1)))).otherwise(below))

        def cut(ts: Column) -> Column:
            stop = F.array_position(F.transform(ts, lambda t: t["f1"].isNotNull()), True).cast("int")
            own = text.let(stop, lambda k: F.when(k > 0, F.slice(ts, F.lit(1), F.greatest(k, F.lit(1)) - 1)).otherwise(ts))
            return text.let(own, lambda own: F.struct(own.alias("own"), F.trim(F.regexp_replace(F.trim(_joined(own)), r"^[:\-\s]+", "")).alias("raw"), F.get(ts, F.lit(0))["line_no"].alias("around")))

        return text.let(text.let(rest, right), lambda ts: F.struct(h["field"].alias("field"), cut(ts).alias("v")))

    marked = F.flatten(F.transform(lines, lambda ts: F.filter(ts, lambda t: t["f1"].isNotNull() | t["f2"].isNotNull() | t["f3"].isNotNull())))
    found = F.filter(F.transform(F.flatten(F.transform(marked, hit)), value), lambda x: x["v"]["raw"] != "")
    return text.let(found, lambda fs: F.filter(fs, lambda x, k: ~F.exists(F.slice(fs, 1, k), lambda e: e["field"] == x["field"])))


# Dates, six-digit codes and identifiers in running text. The code's pattern also takes the fifteen characters before it;
# it looks back for them only where a code stands.
DOB = r"\b(\d{1,2}[-/. ](?:\d{1,2}|[A-Za-z]{3,9})[-/. ]\d{2,4})\b"
PIN = r"(?s)(?=[1-9][0-9]{5}\b)(?<![A-Za-z0-9\-_])(?<=(^.{0,14}|.{15}))([1-9][0-9]{5})\b"
ID = r"\b([A-Z]{2,4}[-\s]?[0-9]{6,12})\b"
ADDRESS_TOLD = rf"(?U)(?:^|\s)(?:{'|'.join(C.ADDRESS_WORDS)})(?:\s|$)|{'|'.join(ROADS)}"


def reads_as_date(raw: Column) -> Column:
    return ~F.array_contains(dates.any_date_parts(raw)["rules"], "RULE_DATE_PARSE_FAILED")


def first_date(whole: Column) -> Column:
    """The first thing in a text that reads as a date, as it stands there; null if none."""
    return F.get(F.filter(F.transform(F.regexp_extract_all(whole, F.lit(DOB), F.lit(1)), lambda x: F.trim(x)), reads_as_date), F.lit(0))


def first_identifier(whole: Column) -> Column:
    """The first identifier in a text; null if none."""
    return F.nullif(F.regexp_extract(whole, ID, 1), F.lit(""))


def pin_window(whole: Column, read: Column) -> Column:
    """The tokens about the first six-digit code that stands in an address: eight before its first token and one after; null if none.

    Codes after words that announce other numbers don't count, nor do windows without a word of addresses.
    """
    codes, before = F.regexp_extract_all(whole, F.lit(PIN), F.lit(2)), F.regexp_extract_all(whole, F.lit(PIN), F.lit(1))
    announced = lambda b: text.has_any(F.lower(b), C.PIN_BLOCKERS)
    free = F.transform(F.filter(F.arrays_zip(codes.alias("code"), before.alias("before")), lambda m: ~announced(m["before"])), lambda m: m["code"])

    def window(code: Column) -> Column:
        at = F.array_position(F.transform(read, lambda t: F.contains(t["text"], code)), True)  # from 1; 0 if none
        return text.let(at.cast("int"), lambda k: F.when(k > 0, F.slice(read, F.greatest(F.lit(1), k - 8), F.least(k, F.lit(9)) + 1)))

    told = lambda ts: F.lower(_joined(ts)).rlike(ADDRESS_TOLD)
    return F.get(F.filter(F.transform(free, window), lambda ts: ts.isNotNull() & told(ts)), F.lit(0))


def touching(read: Column, raw: Column, parts: Column) -> Column:
    """Tokens that hold ``raw`` or one of ``parts``."""
    return F.filter(read, lambda t: F.contains(t["text"], raw) | F.exists(parts, lambda p: F.contains(t["text"], p)))


def by_pattern(have: Column) -> Column:
    """Birth date, address and identifier from the running text of ``pages``, where ``have`` (names of fields) lacks them."""
    col, academic = F.col, text.has_any(F.lower(F.col("text")), C.ACADEMIC)
    none = F.array().cast("array<string>")
    dob = F.when(~F.array_contains(have, "dob"), first_date(col("text")))
    dob_on = lambda raw: F.filter("read", lambda t: F.contains(raw, t["text"]) | F.contains(t["text"], raw))
    nothing = F.filter("read", lambda t: F.lit(False))
    made = lambda name, raw, own, default, method: _found(F.lit(name), raw, own, default, method, nothing)
    born = text.let(dob, lambda raw: F.when(raw.isNotNull(), made("dob", raw, dob_on(raw), 0.85, "regex")))
    window = F.when(~F.array_contains(have, "address") & (col("doc_type") != "marksheet") & ~academic, pin_window(col("text"), col("read")))
    lives = text.let(window, lambda ts: F.when(ts.isNotNull(), made("address", _joined(ts), ts, None, "regex_pin_context")))
    number = F.when(~F.array_contains(have, "id_number"), first_identifier(col("text")))
    known = text.let(number, lambda raw: F.when(raw.isNotNull(), made("id_number", raw, touching(col("read"), raw, F.coalesce(text.words(raw), none)), 0.85, "regex_id")))
    return F.array_compact(F.array(born, lives, known))


def found_fields(docs: DataFrame) -> DataFrame:
    """``pages`` with ``fields``: all that was found, by labels, else by patterns."""
    unlined = lambda h: F.forall(h["v"]["own"], lambda t: t["line_id"].isNull())
    around = lambda h: F.when(unlined(h), F.get("lines", h["v"]["around"] - 1)).otherwise(F.slice(F.get("lines", F.lit(0)), 1, 0))
    beside = lambda hits: F.transform(hits, lambda h: _found(h["field"], h["v"]["raw"], _plain(h["v"]["own"]), None, "label_proximity", _plain(around(h))))
    found = text.let(by_label(F.col("lines")), lambda hits: F.concat(beside(hits), by_pattern(F.transform(hits, lambda h: h["field"]))))
    return once(docs, fields=with_evidence(found, F.col("read"))).drop("lines")


def flat_fields(docs: DataFrame) -> DataFrame:
    """One row a document and field, with boxes in columns."""
    box = lambda c, p: [F.get(c, F.lit(k)).alias(f"{p}{n}") for k, n in enumerate("xywh")]
    one = docs.select("case_id", "doc_id", "doc_type", F.explode("fields").alias("f"))
    return one.select("case_id", "doc_id", "doc_type", "f.field", "f.value_raw", "f.ocr_conf", *box("f.box", ""), "f.method", F.col("f.context.span").alias("source_text_span"), *box("f.context.box", "line_"), F.col("f.context.conf").alias("source_line_conf"))


def extract_fields(tokens: DataFrame, gap: int = C.DEFAULT.line_gap) -> DataFrame:
    """One row a document and field found: by labels, else by patterns. ``tokens`` has case, document, position and box, and may have
    the type. One shuffle by document, then pages are read in Arrow batches; ``found_fields`` over ``pages`` is the native form."""
    return flat_fields(read_pages(tokens, gap))


def normalised(fields: DataFrame) -> DataFrame:
    """``value_norm`` and ``rules_applied`` by the field's kind."""
    raw, f = F.col("value_raw"), F.col("field")
    parts = F.when(f.isin("name", "guardian_name"), text.name_parts(raw)).when(f.isin("dob", "issue_date"), dates.date_parts(raw)).when(f == "address", addresses.address_parts(raw)).otherwise(ids.id_parts(raw))
    return fields.withColumn("_p", parts).withColumn("value_norm", F.col("_p.value")).withColumn("rules_applied", F.col("_p.rules")).drop("_p")


def value_of(field: Column, raw: Column) -> Column:
    """The normalised value alone, by the field's kind."""
    return F.when(field.isin("name", "guardian_name"), text.name_value(raw)).when(field.isin("dob", "issue_date"), dates.date_value(raw)).when(field == "address", addresses.address_value(raw)).otherwise(ids.id_value(raw))


def evidence_line(field: Column, doc: Column, raw: Column, span: Column) -> Column:
    return F.concat(doc, F.lit(" "), field, F.lit(": "), raw, F.coalesce(F.concat(F.lit(" (line: "), span, F.lit(")")), F.lit("")))


def highlight(span: Column, value: Column) -> Column:
    """struct(before, hit, after) at the value's first occurrence in the span; all of it before where there is none."""
    at = F.call_function("position", value, span)
    hit = (at > 0) & (value != "")
    return F.struct(
        F.when(hit, F.substring(span, F.lit(1), at - 1)).otherwise(span).alias("before"), F.when(hit, value).otherwise("").alias("hit"),
        F.when(hit, F.substring(span, at + F.length(value), F.length(span))).otherwise("").alias("after"),
    )


def retry_needed(documents: DataFrame, fields: DataFrame, least: float = C.DEFAULT.retry_confidence, also: tuple[str, ...] = ()) -> DataFrame:
    """Critical fields that a document lacks or has below ``least``: ``case_id, doc_id, field, ocr_conf``, and the columns ``also`` of ``fields``."""
    wanted = documents.select("case_id", "doc_id", F.explode(F.array(*map(F.lit, C.CRITICAL_FIELDS))).alias("field"))
    return wanted.join(fields.select("case_id", "doc_id", "field", "ocr_conf", *also), ["case_id", "doc_id", "field"], "left").filter(F.col("ocr_conf").isNull() | (F.col("ocr_conf") < least))


def best_attempt(candidates: DataFrame) -> DataFrame:
    """Of attempts 0, 1, ... at a field the most confident; an equal later one does not replace an earlier."""
    pick = F.max_by(F.struct("attempt", "value_raw", "ocr_conf"), F.struct(F.coalesce("ocr_conf", F.lit(-1.0)), -F.col("attempt"))).alias("best")
    return candidates.groupBy("case_id", "doc_id", "field").agg(pick).select("case_id", "doc_id", "field", "best.attempt", "best.value_raw", "best.ocr_conf")


def retry_rounds(documents: DataFrame, fields: DataFrame, attempt, rounds: int = 2, least: float = C.DEFAULT.retry_confidence, until_confident: bool = False, keep=lambda df: df) -> DataFrame:
    """Critical fields that are missing or below ``least``, read again: ``case_id, doc_id, field, value_raw, ocr_conf, initial_conf, tried, improved_by``.

    ``attempt(k, docs)`` gives the fields (case_id, doc_id, field, value_raw, ocr_conf) of another reading, k = 1, 2, ..., of the documents in
    ``docs(case_id, doc_id)``: those that still have an open field, so each round reads less, and nothing where none is left. A reading replaces
    the value if its confidence is strictly higher than the best before (0 for a missing field). A field is open until the first
    improvement, or with ``until_confident`` until it has ``least``. ``tried`` counts the readings that were made for it. What a round leaves
    is used twice, so ``keep`` should hold it (``plans.pipeline.kept``).
    """
    keys = ["case_id", "doc_id", "field"]
    start = retry_needed(documents, fields, least, ("value_raw",))  # the first reading is made once
    state = start.select(*keys, "value_raw", F.col("ocr_conf").cast("double").alias("ocr_conf"), F.coalesce(F.col("ocr_conf").cast("double"), F.lit(0.0)).alias("initial_conf"), F.lit(0).alias("tried"), F.lit(None).cast("int").alias("improved_by"))
    for k in range(1, rounds + 1):
        still = (F.coalesce("ocr_conf", F.lit(0.0)) < least) if until_confident else F.col("improved_by").isNull()
        state = keep(state)
        again = attempt(k, state.filter(still).select("case_id", "doc_id").distinct()).select(*keys, F.col("value_raw").alias("_raw"), F.col("ocr_conf").cast("double").alias("_conf"))
        better = still & (F.col("_conf") > F.coalesce("ocr_conf", F.lit(0.0)))
        met = state.join(again, keys, "left").withColumn("_open", still).withColumn("_better", F.coalesce(better, F.lit(False)))
        state = met.select(
            *keys, F.when(F.col("_better"), F.col("_raw")).otherwise(F.col("value_raw")).alias("value_raw"), F.when(F.col("_better"), F.col("_conf")).otherwise(F.col("ocr_conf")).alias("ocr_conf"), "initial_conf",
            (F.col("tried") + F.col("_open").cast("int")).alias("tried"), F.when(F.col("_better"), F.lit(k)).otherwise(F.col("improved_by")).alias("improved_by"),
        )
    return state


def with_retries(fields: DataFrame, retried: DataFrame) -> DataFrame:
    """``fields`` (case_id, doc_id, field, value_raw, ocr_conf) with the values that ``retry_rounds`` improved in the place of the old ones."""
    keys = ["case_id", "doc_id", "field"]
    won = retried.filter("improved_by is not null").select(*keys, "value_raw", "ocr_conf")
    return fields.select(*keys, "value_raw", "ocr_conf").join(won.select(*keys), keys, "left_anti").unionByName(won)
