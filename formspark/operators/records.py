"""Evidence, competing options, readings, records, corrections and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formspark.functions import rules
from formspark.functions.text import equivalent, joined_parts, squash
from formspark.functions.validate import assess

# ---- evidence


def needs_reader(ink: Column) -> Column:
    """Without any ink a field is empty and no reader sees it; -1, not measured, needs one."""
    return ink != 0


def ink_hint(raw: Column, core: Column, base: Column) -> Column:
    return F.when(raw == 0, "empty").when(core < rules.INK_FAINT + rules.INK_FAINT_SHARE * base, "faint").otherwise("strong")


def ink_verdict(ink: Column, base: Column) -> Column:
    """blank, filled, or nothing where the measurement doesn't tell."""
    return F.when(ink < 0, "").when(ink <= rules.INK_TRACE, "blank").when((ink >= rules.INK_SURE) & (ink >= rules.INK_TIMES * F.coalesce(base, F.lit(0))), "filled").otherwise("")


def page_problems(inliers: Column, coverage: Column, offset: Column) -> Column:
    found = F.array(
        F.when(inliers < rules.MIN_INLIERS, "few matches"),
        F.when(coverage < rules.MIN_COVERAGE, "low coverage"),
        F.when(offset > rules.MAX_OFFSET, "offset too large"),
    )
    return F.array_compact(found)


def best_template(df: DataFrame, keys: list[str], inliers: str, template: str, preferred: str) -> DataFrame:
    """(keys, template, inliers, searched): the preferred template if it has MIN_INLIERS, else that with most.

    Page order is trusted where it holds; a search's ties go to the preferred
    template, then to the smallest.
    """
    own = F.col(template) == F.col(preferred)
    order = F.struct(F.col(inliers), own.cast("int").alias("p"), (-F.col(template)).alias("t"))
    best = df.groupBy(*keys).agg(F.max(F.when(own, F.col(inliers))).alias("__own"), F.max(F.when(own, F.col(template))).alias("__preferred"), F.max_by(template, order).alias("__best"), F.max(inliers).alias("__most"))
    holds = F.coalesce(F.col("__own") >= rules.MIN_INLIERS, F.lit(False))
    return best.select(*keys, F.when(holds, F.col("__preferred")).otherwise(F.col("__best")).alias("template"), F.when(holds, F.col("__own")).otherwise(F.col("__most")).alias("inliers"), (~holds).alias("searched"))


def claims(df: DataFrame, target: str, order: list[str]) -> DataFrame:
    """The first claimer of each target, and who came later."""
    w = Window.partitionBy(target).orderBy(*order)
    return df.withColumns({"claim": F.row_number().over(w).cast("long"), "first_claimer": F.first(order[0]).over(w)}).withColumn("duplicate", F.col("claim") > 1)


# ---- competing options


def resolve_options(df: DataFrame, question: list[str], interior: str, halo: str, many: Column) -> DataFrame:
    """checked, score and confidence of each option of a question.

    All options are measured alike: by interior, or by halo where no interior
    is marked.  A pick-one question needs a winner that holds most of the ink.
    """
    w = Window.partitionBy(*question)
    df = df.withColumns({"__many": F.bool_or(many).over(w), "__n": F.count(F.lit(1)).over(w), "by_halo": F.max(interior).over(w) < rules.TICK_ON})
    df = df.withColumn("__s", F.when(F.col("by_halo"), F.col(halo)).otherwise(F.col(interior)))
    df = df.withColumns({"__best": F.max("__s").over(w), "share": F.col("__s") / F.greatest(F.sum("__s").over(w), F.lit(1e-9))})
    on = F.col("__s") >= rules.TICK_ON
    checked = F.when(F.col("__many") | (F.col("__n") == 1), on).otherwise(on & (F.col("__s") == F.col("__best")) & (F.col("share") >= rules.TICK_SHARE))
    df = df.withColumn("checked", checked)
    sure = F.when(F.col("checked"), ~F.col("by_halo") & (F.col("share") > rules.TICK_SURE)).otherwise(F.col("__s") < rules.TICK_ON * 0.5)
    return df.withColumns({"confidence": F.when(sure, "high").otherwise("low"), "score": F.col("__s")}).drop("__many", "__n", "__s", "__best")


# ---- readings


def unread(items: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to read."""
    return items.join(cache.select(*keys).distinct(), keys, "left_anti")


def forced(cache: DataFrame, page: str, pages: list[int] | None) -> DataFrame:
    """The cache that a forced run keeps: nothing of the pages asked for, nothing at all without any."""
    return cache.where(F.lit(False)) if pages is None else cache.where(~F.col(page).isin(pages))


def sweep(df: DataFrame, first: str, second: str, kind: str) -> DataFrame:
    """A second reading replaces the first if it is valid, not blank against a value, and different."""
    a, b = assess(F.col(second), F.col(kind)), assess(F.col(first), F.col(kind))
    df = df.withColumns({"__a": a, "__b": b})
    takes = F.col(second).isNotNull() & F.col("__a.valid") & ~(F.col("__a.empty") & ~F.col("__b.empty")) & (F.coalesce("__a.value", F.lit("")) != F.coalesce("__b.value", F.lit("")))
    df = df.withColumn("replaced", takes)
    return df.withColumns({
        "value": F.when(F.col("replaced"), F.col(second)).otherwise(F.col(first)),
        "source": F.when(F.col("replaced"), "ocr-sweep").otherwise("page"),
        "disputed": F.col("replaced") & (F.coalesce(F.col(first), F.lit("")) != "") & ~F.col("__b.empty"),
    }).drop("__a", "__b")


def sweeps(kind: Column, verdict: Column, source: Column) -> Column:
    return kind.isin(rules.READER_TYPES) & (verdict != "blank") & (source == "page")


def retry_reason(present: Column, source: Column, found: Column, verdict: Column) -> Column:
    """Why a field is read again, or null; ``found`` is its assessment."""
    page = present & (source == "page")
    return (
        F.when(~present, "nothing was returned")
        .when(page & ~found["valid"], found["note"])
        .when(page & (verdict == "filled") & found["empty"], "clear ink in this box but nothing was read")
        .when(page & (verdict == "blank") & ~found["empty"], "no ink in this box, yet a value was read")
    )


def retry_takes(second: Column, first: Column, found: Column) -> Column:
    """A further reading is taken if it is valid or there was none."""
    return second.isNotNull() & (found["valid"] | first.isNull())


# ---- records


def confidence(source: Column, found: Column, disputed: Column, hint: Column, verdict: Column) -> Column:
    """struct(confidence, note): the first rule that applies."""
    own = found["note"]
    note = lambda text: F.coalesce(F.nullif(own, F.lit("")), F.lit(text))
    level = lambda c, n: F.struct(F.lit(c).alias("confidence"), n.alias("note"))
    return (
        F.when(source == "not-read", level("low", note("no value produced")))
        .when(~found["valid"], level("low", own))
        .when(disputed, level("low", note("readers disagreed")))
        .when(source == "ink-gate", level("high", own))
        .when(source == "read-with-parent", level("high", note("read together with the line above")))
        .when((hint == "faint") & ~found["empty"], level("low", note("faint ink but a value was read")))
        .when((verdict == "filled") & found["empty"] & ~found["explicit_none"], level("low", note("ink present but read as empty")))
        .otherwise(level("high", own))
    )


def source_name(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in rules.SOURCE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.coalesce(c, F.lit(""))), F.lit("not-read"))


def needs_review(level: Column, valid: Column, problems: Column) -> Column:
    return (level == "low") | ~valid | (F.size(problems) > 0)


def assemble(fields: DataFrame, index: DataFrame, reads: DataFrame, pages: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """One record for each readable field with evidence and each measured tick box.

    fields(doc, field, page, section, label, kind, type, ordinal [, group,
    table, continuation_of, select_mode]), index(doc, field, ink_hint, ink_px,
    baseline_px), reads(doc, field, value, source, model, disputed), pages(doc,
    page, problems), ticks(doc, field, checked, score, confidence
    [, select_mode]).  A text field's group is its table.  Fields without
    evidence and boxes without a measurement drop out; readings and pages may
    be missing.
    """
    for c in ("group", "table", "continuation_of", "select_mode"):
        if c not in fields.columns:
            fields = fields.withColumn(c, F.lit(""))
    pages = pages.select("doc", "page", "problems")
    tick = F.col("kind") == "checkbox"
    df = fields.where(~tick).join(index, ["doc", "field"]).join(reads.withColumnRenamed("value", "reading"), ["doc", "field"], "left").join(pages, ["doc", "page"], "left")
    df = df.withColumns({"found": assess(F.col("reading"), F.col("type")), "source": source_name(F.col("source")), "problems": F.coalesce("problems", F.array().cast("array<string>"))})
    level = confidence(F.col("source"), F.col("found"), F.coalesce("disputed", F.lit(False)), F.col("ink_hint"), ink_verdict(F.col("ink_px"), F.col("baseline_px")))
    df = df.withColumn("__level", level)
    records = df.select(
        "doc", "field", "page", "section", "label", F.col("table").alias("group"), "kind", "type", "ordinal", F.col("found.value").alias("value"), F.coalesce("reading", F.lit("")).alias("raw"), "source", F.coalesce("model", F.lit("")).alias("model"),
        F.col("__level.confidence").alias("confidence"), F.col("found.valid").alias("valid"), F.col("__level.note").alias("note"), F.col("ink_hint").cast("string").alias("ink_hint"), F.col("ink_px").cast("long").alias("ink_px"), "continuation_of", F.lit("").alias("select_mode"),
        F.col("problems").alias("page_problems"), needs_review(F.col("__level.confidence"), F.col("found.valid"), F.col("problems")).alias("needs_review"),
    )
    if ticks is None:
        return records
    mode = F.coalesce(F.nullif(F.col("measured_mode"), F.lit("")), F.nullif(F.col("select_mode"), F.lit("")), F.lit("one"))
    measured = ticks if "select_mode" in ticks.columns else ticks.withColumn("select_mode", F.lit(""))
    boxes = fields.where(tick).join(measured.withColumnRenamed("select_mode", "measured_mode"), ["doc", "field"]).join(pages, ["doc", "page"], "left")
    boxes = boxes.withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))
    return records.unionByName(boxes.select(
        "doc", "field", "page", "section", "label", "group", "kind", F.lit("boolean").alias("type"), "ordinal", F.when(F.col("checked"), "true").otherwise("false").alias("value"), F.col("score").cast("string").alias("raw"), F.lit("checkbox-cv").alias("source"), F.lit("").alias("model"),
        "confidence", F.lit(True).alias("valid"), F.lit("").alias("note"), F.lit(None).cast("string").alias("ink_hint"), F.lit(None).cast("long").alias("ink_px"), F.lit("").alias("continuation_of"), mode.alias("select_mode"),
        F.col("problems").alias("page_problems"), needs_review(F.col("confidence"), F.lit(True), F.col("problems")).alias("needs_review"),
    ))


def ticked(records: DataFrame) -> DataFrame:
    """(doc, question, option): the ticked option of each question, the last where there are several."""
    named = records.where("kind = 'checkbox' and value = 'true'").withColumn("question", F.coalesce(F.nullif(F.col("group"), F.lit("")), F.col("label")))
    return named.groupBy("doc", "question").agg(F.max_by("label", "ordinal").alias("option"))


def cross_check(records: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, issue): rules that span fields.

    records(doc, field, value, ordinal [, kind, group, label]); tick boxes
    among them give the gender.  The birth date is that of the first page.
    """
    text = records.where("kind <> 'checkbox'") if "kind" in records.columns else records
    first = lambda cond: F.min_by(F.when(cond, F.col("value")), F.when(cond & (F.coalesce(F.col("value"), F.lit("")) != ""), F.col("ordinal")))
    has = lambda s: F.contains(F.col("field"), F.lit(s))
    wide = text.groupBy(doc).agg(
        first(has("date_of_issue")).alias("issue"), first(has("date_of_expiry")).alias("expiry"), first(has("date_of_birth") & has("p1")).alias("birth"), first(has("id_no") | has("cnic")).alias("cnic"),
        first(has("title_of_account")).alias("title"), first(has("first_name")).alias("given"), first(has("last_name")).alias("family"),
    )
    if "kind" in records.columns:
        gender = ticked(records.withColumnRenamed(doc, "doc")).where("question = 'Gender'").select(F.col("doc").alias(doc), F.col("option").alias("gender"))
        return issues(wide.join(gender, doc, "left"), [doc])
    return issues(wide.withColumn("gender", F.lit(None).cast("string")), [doc])


def issues(wide: DataFrame, keys: list[str]) -> DataFrame:
    """The rules of ``cross_check`` on one row a document; a date that isn't one says nothing."""
    day = lambda c: F.try_to_timestamp(F.when(F.length(c) == 8, F.col(c)), F.lit("ddMMyyyy"))
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    issue, expiry, birth = day("issue"), day("expiry"), day("birth")
    last = F.right(F.regexp_replace("cnic", "[^0-9]", ""), F.lit(1))
    implied = F.when(last.isin("1", "3", "5", "7", "9"), "male").when(last != "", "female")
    gender = F.lower(F.btrim("gender"))
    named = F.contains(letters("title"), letters("given")) | F.contains(letters("title"), letters("family"))
    rules_ = F.array(
        F.when(expiry <= issue, rules.ISSUES["expiry"]),
        F.when(birth >= issue, rules.ISSUES["birth"]),
        F.when(F.year(birth) > rules.LAST_BIRTH_YEAR, F.format_string(rules.ISSUES["year"], F.year(birth).cast("string"))),
        F.when(gender.isin("male", "female") & (implied != gender), F.format_string(rules.ISSUES["gender"], last, implied, F.initcap(gender))),
        F.when(F.col("title").isNotNull() & F.col("given").isNotNull() & F.col("family").isNotNull() & ~named, F.format_string(rules.ISSUES["title"], F.col("title"))),
    )
    return wide.select(*keys, F.explode(F.array_compact(rules_)).alias("issue"))


def form_answers(records: DataFrame) -> DataFrame:
    """(doc, section, n, name, answer): one row a question of ``assemble``'s records; answer is a list.

    A text answer is one string, with its wrapped lines joined; a tick
    question has its ticked options.  Text comes first, then tick questions,
    each in order; a name that its section has already gets a number.
    """
    from formspark.operators.layout import numbered_labels

    df = records.withColumn("section", F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit(rules.NO_SECTION)))
    text = df.where("kind <> 'checkbox'")
    own = text.select("doc", F.coalesce(F.nullif(F.col("continuation_of"), F.lit("")), F.col("field")).alias("of"), F.coalesce(F.col("continuation_of"), F.lit("")).alias("wrapped"), "ordinal", F.coalesce("value", F.lit("")).alias("value"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct((F.col("wrapped") != "").alias("later"), "ordinal", "value"))), lambda x: x["value"])
    joined = own.groupBy("doc", "of").agg(joined_parts(parts).alias("answer"))
    heads = text.where("coalesce(continuation_of, '') = ''").join(joined.withColumnRenamed("of", "field"), ["doc", "field"]).where("answer <> ''")
    label = F.when(F.coalesce("group", F.lit("")) != "", F.concat("group", F.lit(" - "), "label")).otherwise(F.col("label"))
    texts = heads.select("doc", "section", F.lit(0).alias("__late"), F.col("ordinal").cast("long").alias("__at"), label.alias("__label"), F.array("answer").alias("answer"))
    boxes = df.where("kind = 'checkbox'").withColumn("__label", F.coalesce(F.nullif(F.col("group"), F.lit("")), F.col("label")))
    picked = F.transform(F.sort_array(F.collect_list(F.when(F.col("value") == "true", F.struct("ordinal", "label")))), lambda x: x["label"])
    ticks = boxes.groupBy("doc", "section", "__label").agg(F.min("ordinal").cast("long").alias("__at"), picked.alias("answer")).where(F.size("answer") > 0)
    both = texts.unionByName(ticks.select("doc", "section", F.lit(1).alias("__late"), "__at", "__label", "answer"))
    named = numbered_labels(both, ["doc", "section"], "__label", ["__late", "__at", "__label"])
    n = F.row_number().over(Window.partitionBy("doc", "section").orderBy("__late", "__at", "__label"))
    return named.select("doc", "section", n.cast("long").alias("n"), "name", "answer")


def result_documents(records: DataFrame, issues_: DataFrame, alignment: DataFrame) -> DataFrame:
    """(document, fields, answers, cross_check, alignment): the whole result, a row a document."""
    one = lambda c: F.transform(c, lambda x: x["v"])
    fields = records.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("ordinal", "field", F.struct(*[c for c in records.columns if c != "doc"]).alias("v")))).alias("f")).select("doc", one(F.col("f")).alias("fields"))
    sections = form_answers(records).groupBy("doc", "section").agg(F.sort_array(F.collect_list(F.struct("n", F.struct(F.col("name").alias("key"), F.col("answer").alias("value")).alias("v")))).alias("a"))
    answers = sections.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("section", F.map_from_entries(one(F.col("a")))))).alias("answers"))
    found = issues_.groupBy("doc").agg(F.sort_array(F.collect_list("issue")).alias("cross_check"))
    pages = alignment.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(*[c for c in alignment.columns if c != "doc"]))).alias("alignment"))
    out = fields.join(answers, "doc", "left").join(found, "doc", "left").join(pages, "doc", "left")
    return out.withColumnRenamed("doc", "document").withColumn("cross_check", F.coalesce("cross_check", F.array().cast("array<string>")))


def answers_view(df: DataFrame, doc: str, section: str, name: str, value: str, order: str) -> DataFrame:
    """(doc, section, answers): a map from name to value, in order."""
    entries = F.transform(F.sort_array(F.collect_list(F.struct(order, F.struct(F.col(name).alias("k"), F.col(value).alias("v")).alias("e")))), lambda x: x["e"])
    return df.groupBy(doc, section).agg(F.map_from_entries(entries).alias("answers"))


def question_rows(df: DataFrame, keys: list[str], order: str, option: str, picked: str, many: Column) -> DataFrame:
    """A row a question: its picked options, whether any needs a review or a pick-one has several."""
    chosen = F.transform(F.sort_array(F.collect_list(F.when(F.col(picked), F.struct(order, option)))), lambda x: x[option])
    out = df.groupBy(*keys).agg(F.array_join(chosen, ", ").alias("answer"), F.count_if(picked).alias("picked"), F.bool_or(F.col(picked) & F.col("needs_review")).alias("flagged"), F.bool_or(many).alias("many"))
    return out.withColumn("needs_review", F.coalesce(F.col("flagged"), F.lit(False)) | ((F.col("picked") > 1) & ~F.col("many"))).drop("flagged", "many")


def folded(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Parts of a wrapped answer joined in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return df.groupBy(*keys).agg(joined_parts(parts).alias("value"), F.count(F.lit(1)).alias("parts"))


# ---- corrections


def current_edits(log: DataFrame, keys: list[str]) -> DataFrame:
    """The edit in force of each field: the latest, with the first original since the last revert."""
    w = Window.partitionBy(*keys)
    reverted = F.max(F.when(F.col("reverted"), F.col("at"))).over(w)
    live = log.withColumn("__since", reverted).where("__since is null or at > __since").drop("__since")
    return live.groupBy(*keys).agg(F.max_by("value", "at").alias("edit"), F.min_by("original", "at").alias("original"), F.count(F.lit(1)).alias("edits"))


def overlay(records: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Records (value, type, kind, valid, note, source, confidence, needs_review) with edits, validated anew."""
    df = records.join(edits, keys, "left").withColumn("__edited", F.col("edit").isNotNull())
    df = df.withColumn("__found", assess(F.col("edit"), F.col("type")))
    tick = F.col("kind") == "checkbox"
    valid = F.when(tick, F.lit(True)).otherwise(F.col("__found.valid"))
    ticked = F.when(F.lower("edit").isin("false", "0", "", "no"), "false").otherwise("true")
    note = F.when(tick, "corrected by reviewer").otherwise(F.coalesce(F.nullif(F.col("__found.note"), F.lit("")), F.lit("corrected by reviewer")))
    new = {
        "value": F.when(tick, ticked).otherwise(F.col("__found.value")),
        "valid": valid,
        "note": note,
        "source": F.lit("reviewer"),
        "confidence": F.when(valid, "high").otherwise("low"),
        "needs_review": ~valid,
    }
    out = df.withColumns({k: F.when(F.col("__edited"), v).otherwise(F.col(k)) for k, v in new.items()})
    return out.withColumns({"edited": F.col("__edited"), "edited_from": F.col("original")}).drop("edit", "original", "edits", "__edited", "__found")


# ---- scores


def score_values(truth: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """truth(keys, want) against got(keys, value, confidence): exact, normal, empty_right and caught for each."""
    df = truth.join(got, keys, "left").withColumn("have", F.coalesce(F.btrim("value"), F.lit("")))
    blank = F.lower(F.btrim("want")).isin([*rules.NONE_MARKERS, ""])
    return df.withColumns({
        "exact": (F.col("have") == F.btrim("want")) | (blank & (F.col("have") == "")),
        "normal": equivalent(F.col("want"), F.col("have")),
        "empty_right": blank == (F.col("have") == ""),
    }).withColumn("caught", ~F.col("normal") & F.coalesce(F.col("confidence") == "low", F.lit(False)))


def rates(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(*[F.count_if(F.col(c)).alias(c) for c in ("exact", "normal", "empty_right", "caught")], F.count(F.lit(1)).alias("total"))


def folded_truth(truth: DataFrame, got: DataFrame, fields: DataFrame) -> DataFrame:
    """truth(doc, field, want) with wrapped answers that were read as one folded into their first line.

    A line goes into its parent's truth where the parent was read and the line
    itself was not; fields(doc, field, continuation_of, ordinal) say which
    lines go on, got(doc, field, value) what was read.
    """
    read = got.select("doc", "field", (F.coalesce("value", F.lit("")) != "").alias("__read"))
    lines = fields.where("coalesce(continuation_of, '') <> ''").join(truth, ["doc", "field"]).join(read, ["doc", "field"], "left")
    parents = truth.select("doc", F.col("field").alias("continuation_of")).join(read.withColumnsRenamed({"field": "continuation_of", "__read": "__parent"}), ["doc", "continuation_of"])
    gone = lines.join(parents, ["doc", "continuation_of"]).where("__parent and not coalesce(__read, false)")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "want"))), lambda x: x["want"])
    more = gone.groupBy("doc", F.col("continuation_of").alias("field")).agg(parts.alias("__more"))
    kept = truth.join(gone.select("doc", "field"), ["doc", "field"], "left_anti").join(more, ["doc", "field"], "left")
    return kept.withColumn("want", F.when(F.col("__more").isNotNull(), joined_parts(F.concat(F.array("want"), F.col("__more")))).otherwise(F.col("want"))).drop("__more")


# ---- reports


def kind_counts(df: DataFrame, keys: list[str], kind: str, kinds: list[str], total: str | None = None) -> DataFrame:
    """A row of counts by kind for each key and, where ``total`` names it, one for all."""
    counts = [F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    out = df.groupBy(*keys).agg(*counts)
    return out if total is None else out.unionByName(df.agg(*counts).select(F.lit(total).alias(keys[0]), *(F.lit(None).cast(dict(df.dtypes)[k]).alias(k) for k in keys[1:]), *kinds))


def section_summary(df: DataFrame, keys: list[str], filled: Column, flagged: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(filled).alias("filled"), F.count_if(flagged).alias("flagged"))


def review_list(df: DataFrame, flagged: Column, order: list[str], most: int = 40) -> DataFrame:
    """The first flagged records, for a report."""
    return df.where(flagged).orderBy(*order).limit(most)


def without(df: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the others lack: truth that nothing was read for, ticks that truth doesn't have."""
    return df.join(others.select(*keys).distinct(), keys, "left_anti")


def answers_csv(records: DataFrame) -> DataFrame:
    """The columns of a CSV result, null where records lack one, in (page, field) order."""
    return records.orderBy("page", "field").select(*[F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in rules.CSV_COLUMNS])
