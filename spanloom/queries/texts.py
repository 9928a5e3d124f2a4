"""Queries on texts and spans: C, T, A, W, O, X and G operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as t
from spanloom.functions.markup import text_of_html
from spanloom.operators import entities, extract, punctuation, sentences, spans, training
from spanloom.queries.common import DATA, DOCS, SPANS, data, docs, strip_sql
from spanloom.session import table
from spanloom.transformers import TextLemmatizer, TextNormalizer, TextStemmer, stop_words

def _text():
    return F.col("text")



def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _spans(df: DataFrame, *keep: str) -> DataFrame:
    """Spans as rows."""
    return df.select("id", *keep, F.inline("entities")).select("id", *keep, "start", "end", "class")


# --- Scalar functions ---


def fixed_keywords(spark, d):
    return table(spark, d, "keyword").select("id", t.fix_keyword(F.col("value")).alias("value"))


def fixed_text(spark, d):
    return _corpus(spark, d).select("id", t.fix_text(_text()).alias("text"))


def stripped_characters(spark, d):
    return _corpus(spark, d).select("id", t.strip_characters(_text()).alias("text"))


def normalized(spark, d):
    return TextNormalizer(inputCol="text", outputCol="norm", stripCharacters=True).transform(_corpus(spark, d)).select("id", "norm")


def without_stopwords(spark, d):
    return _corpus(spark, d).select("id", t.remove_stopwords(F.lower(_text()), stop_words(spark, "russian")).alias("text"))


def stop_word_share(spark, d):
    words = _corpus(spark, d).select("id", t.words(F.lower(_text())).alias("w"))
    listed = F.array(*[F.lit(w) for w in stop_words(spark, "russian")])
    return words.select(
        "id",
        F.size("w").alias("n_words"),
        F.size(F.filter("w", lambda w: F.array_contains(listed, w))).alias("n_stop"),
        F.size(F.filter("w", t.is_punctuation)).alias("n_marks"),
    ).where("n_words >= 0")


def without_tags(spark, d):
    return _corpus(spark, d).select("id", text_of_html(_text()).alias("text"))


def stemmed(spark, d):
    return TextStemmer(inputCol="text", outputCol="stems").transform(_corpus(spark, d)).select("id", "stems")


def lemmatized(spark, d):
    return TextLemmatizer(inputCol="text", outputCol="lemmas", lemmas=_LEMMAS).transform(docs(spark, d, "id", "text")).select("id", "lemmas")


def script_of_words(spark, d):
    kw = table(spark, d, "keyword").select("id", "value")
    return kw.select("id", t.has_no_cyrillic(F.col("value")).alias("english"), t.is_punctuation(F.col("value")).alias("marks"), t.is_blank(F.col("value")).alias("blank"))


# --- Sentences and marks ---


def sentence_rows(spark, d):
    return _corpus(spark, d).select("id", F.posexplode(sentences.extract_sentences(_text())).alias("pos", "s")).select("id", "pos", "s.offset", "s.text")


def line_lengths(spark, d):
    return _corpus(spark, d).select("id", F.round(sentences.mean_line_length(_text()), 6).alias("mean_length"))


def joined_sentences(spark, d):
    return data(spark, d).select("id", sentences.join_sentences(_text()).alias("text"))


def attached(spark, d):
    s = sentences.attach_entities(sentences.extract_sentences(_text(), F.col("entities")), F.col("entities"), True)
    rows = data(spark, d).where(_text().isNotNull()).select("id", F.posexplode(s).alias("pos", "s"))
    return rows.select("id", "pos", "s.offset", "s.text", F.size("s.entities").alias("n_spans"))


def fixed_punctuation(spark, d):
    return data(spark, d).select("id", punctuation.fix_punctuation(_text()).alias("text"))


def spaced_spans(spark, d):
    return _spans(entities.space_marks(data(spark, d).where(_text().isNotNull()).withColumn("entities", spans.spans_or_none(F.col("entities")))))


def split_words(spark, d):
    v = F.col("value")
    return table(spark, d, "keyword").select(
        "id",
        F.array_join(punctuation.split_by_semicolon(v), "|").alias("semicolon"),
        F.array_join(punctuation.split_by_comma(v), "|").alias("comma"),
        F.array_join(punctuation.split_by_slash(v), "|").alias("slash"),
    )


# --- Tokens and labels ---


def token_frame(spark, d):
    return training.token_rows(training.sentence_rows(data(spark, d)))


def document_labels(spark, d):
    rows = training.labels_of(data(spark, d))
    return rows.select("id", F.size("labels").alias("n_sentences"), F.size(F.flatten("tokens")).alias("n_tokens"), F.size(F.filter(F.flatten("labels"), lambda x: x != "O")).alias("n_tagged"))


def decoded(spark, d):
    rows = training.sentence_rows(data(spark, d))
    return rows.select("id", "sentence", F.inline(spans.decode_tags(F.col("tokens"))))


def decoded_by_windows(spark, d):
    """The same spans from token rows, as islands of a running sum."""
    rows = training.sentence_rows(data(spark, d)).select("id", "sentence", F.posexplode("tokens").alias("pos", "x"))
    rows = rows.select("id", "sentence", "pos", "x.*")
    w = Window.partitionBy("id", "sentence").orderBy("pos")
    kind = F.when(F.col("tag") != "O", F.substring_index("tag", "-", -1))
    rows = rows.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    new = F.col("kind").isNotNull() & (F.col("tag").startswith("B") | ~F.col("kind").eqNullSafe(F.col("before")))
    rows = rows.withColumn("island", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind is not null")
    return rows.groupBy("id", "sentence", "island", "kind").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.length("token")).alias("end")).select(
        "id", "sentence", "start", "end", F.col("kind").alias("class")
    )


def annotated(spark, d):
    rows = data(spark, d).where(_text().isNotNull()).withColumn("entities", spans.by_start(spans.spans_or_none(F.col("entities"))))
    return rows.select("id", F.posexplode(spans.annotated(_text(), F.col("entities"))).alias("pos", "p")).select("id", "pos", "p.text", "p.class")


def label_list(spark, d):
    kinds = [r[0] for r in table(spark, d, "canon_term").select("type").distinct().orderBy("type").collect()]
    return spark.createDataFrame(list(enumerate(spans.label_list(["O", *kinds]))), "pos int, label string")


def evaluation(spark, d):
    """A baseline tagger by majority, judged on its own training rows by kind."""
    rows = data(spark, d).withColumn("kind", F.substring_index("id", "-", 1))
    tok = training.prepare_training(rows)
    best = training.majority_tags(tok).withColumnRenamed("label", "guess")
    return training.evaluate(tok.withColumn("word", F.lower("word")).join(best, "word"))


# --- Spans ---


def non_empty_spans(spark, d):
    return _spans(data(spark, d).withColumn("entities", spans.non_empty(F.col("entities"))))


def ordered_spans(spark, d):
    rows = data(spark, d).withColumn("entities", spans.by_start(spans.spans_or_none(F.col("entities"))))
    return rows.select("id", F.posexplode("entities").alias("pos", "e")).select("id", "pos", "e.start", "e.end", "e.class")


def filtered(spark, d):
    return _spans(spans.filter_rejected(data(spark, d).where(_text().isNotNull())))


def filtered_status(spark, d):
    return spans.filter_rejected(data(spark, d).where(_text().isNotNull())).select("id", F.explode("status").alias("value", "status"))


def token_classes(spark, d):
    seen = data(spark, d).select("text", F.explode("entities").alias("e"))
    return seen.groupBy(spans.value_of(_text(), F.col("e")).alias("token"), F.col("e.class").alias("class")).agg(F.count("*").alias("n"))


def majority_class(spark, d):
    return entities.majority_class(data(spark, d))


def with_majority(spark, d):
    return _spans(entities.with_majority_class(data(spark, d)))


def _language_names(spark, d):
    return [r[0] for r in table(spark, d, "canon_term").where("type = 'ProgLanguage'").select(F.lower("name")).distinct().collect()]


def overridden(spark, d):
    """The dictionary meets the spans by keyword."""
    names = table(spark, d, "canon_term").where("type = 'ProgLanguage'").select(F.lower("name").alias("token"), F.lit("ProgLanguage").alias("class")).distinct()
    return _spans(entities.with_class_of(data(spark, d).where(_text().isNotNull()), names))


#: Inflected forms of the words that say nothing at the start of a skill, by lemma.
_FORMS = {
    "знание": "знания знанию знанием знании знаний знаниям знаниями знаниях",
    "владеть": "владею владеешь владеет владеем владеете владеют владел владела владело владели владей владейте владея владеющий владеющая владеющее владеющие "
    "владеющего владеющей владеющих владеющему владеющим владеющую владеющем владеющими",
    "знать": "знаю знаешь знает знаем знаете знают знал знала знало знали знай знайте зная знающий знающая знающее знающие знающего знающей знающих знающему "
    "знающим знающую знающем знающими",
    "хороший": "хорошая хорошее хорошие хорошего хорошей хороших хорошему хорошим хорошую хорошем хорошими хорошею",
    "отличный": "отличная отличное отличные отличного отличной отличных отличному отличным отличную отличном отличными отличною",
    "прекрасный": "прекрасная прекрасное прекрасные прекрасного прекрасной прекрасных прекрасному прекрасным прекрасную прекрасном прекрасными прекрасною",
    "умение": "умения умению умением умении умений умениям умениями умениях",
    "понимание": "понимания пониманию пониманием понимании пониманий пониманиям пониманиями пониманиях",
    "принцип": "принципа принципу принципом принципе принципы принципов принципам принципами принципах",
    "опыт": "опыта опыту опытом опыте опыты опытов опытам опытами опытах",
    "работа": "работы работе работу работой работою работ работам работами работах",
    "уметь": "умею умеешь умеет умеем умеете умеют умел умела умело умели умей умейте умея умеющий умеющая умеющее умеющие умеющего умеющей умеющих умеющему "
    "умеющим умеющую умеющем умеющими",
    "навык": "навыка навыку навыком навыке навыки навыков навыкам навыками навыках",
    "готовность": "готовности готовностью готовностей готовностям готовностями готовностях",
    "уверенный": "уверенная уверенное уверенные уверенного уверенной уверенных уверенному уверенным уверенную уверенном уверенными уверенною",
    "роль": "роли ролью ролей ролям ролями ролях",
    "знакомство": "знакомства знакомству знакомством знакомстве знакомств знакомствам знакомствами знакомствах",
    "желание": "желания желанию желанием желании желаний желаниям желаниями желаниях",
    "базовый": "базовая базовое базовые базового базовой базовых базовому базовым базовую базовом базовыми базовою",
    "использование": "использования использованию использованием использовании использований использованиям использованиями использованиях",
}
_LEMMAS = {form: lemma for lemma, forms in _FORMS.items() for form in forms.split()}


def _prepared(spark, d):
    return entities.preprocess(data(spark, d), _language_names(spark, d), _LEMMAS)


def preprocessed(spark, d):
    return _prepared(spark, d).select("id", "text", F.size("entities").alias("n_spans"))


def preprocessed_spans(spark, d):
    return _spans(_prepared(spark, d))


def split_spans(spark, d):
    return _spans(data(spark, d).where(_text().isNotNull()).withColumn("entities", punctuation.split_spans(_text(), spans.spans_or_none(F.col("entities")))))


def trimmed_spans(spark, d):
    trim = lambda e: punctuation.trim_span_end(_text(), spans.trim_span_start(_text(), e))
    return _spans(data(spark, d).where(_text().isNotNull()).withColumn("entities", F.transform(spans.spans_or_none(F.col("entities")), trim)))


def cast_texts(spark, d):
    rows = data(spark, d).where(_text().isNotNull())
    return rows.select("id", spans.cast_tokens(spans.join_plus(_text()), F.col("entities")).alias("text"))


def rebuilt(spark, d):
    return _spans(entities.rebuild(data(spark, d).where(_text().isNotNull())), "text")


def _halves(spark, d):
    """New spans are those of class Technology and ProgLanguage, saved ones all; saved statuses as they are."""
    rows = data(spark, d).where(_text().isNotNull())
    new = F.filter(spans.spans_or_none(F.col("entities")), lambda e: e["class"].isin("Technology", "ProgLanguage"))
    return rows.select(
        "id", "text", new.alias("entities"), F.create_map().cast("map<string,string>").alias("status"), F.col("entities").alias("saved_entities"), F.col("status").alias("saved_status")
    )


def merged(spark, d):
    return _spans(spans.merge(_halves(spark, d)))


def merged_status(spark, d):
    return spans.merge(_halves(spark, d)).select("id", F.explode("status").alias("value", "status"))


def rejected_missing(spark, d):
    return _spans(spans.reject_missing(_halves(spark, d)))


def reanchored(spark, d):
    """Spans of the data looked up in the text made of its sentences."""
    rows = data(spark, d).where(_text().isNotNull()).select("id", "text", "entities", "status", sentences.join_sentences(_text()).alias("new_text"))
    return _spans(spans.reanchor(rows))


def span_counts(spark, d):
    """Spans and statuses of each text."""
    return data(spark, d).select("id", F.coalesce(F.size("entities"), F.lit(0)).alias("n"), F.size(F.map_keys(spans.status_or_none(F.col("status")))).alias("n_status")).select(
        "id", F.greatest("n", F.lit(0)).alias("n_spans"), "n_status"
    )


def keyword_spans(spark, d):
    """U2 with the dictionary tagger: known keywords in the texts of documents to extract from."""
    from spanloom.operators import documents

    kw = table(spark, d, "keyword").select("id", t.fix_keyword(F.col("value")).alias("value"), "type")
    return _spans(extract.found_by_dictionary(documents.eligible(docs(spark, d, "id", "is_active", "root_id", "text")).select("id", "text"), kw))


def _latin_words():
    """A tagger: words of Latin letters that begin with a capital."""
    return lambda docs: [["B-Latin" if re.fullmatch("[A-Z][A-Za-z]+", w) else "O" for w in s] for s in docs]


def tagged_spans(spark, d):
    """A tagger that each worker loads once, called with batches of documents."""
    return _spans(extract.extract(data(spark, d).select("id", "text"), _latin_words))


QUERIES = {
    "U1_S9_U3_L1_tagged_spans": tagged_spans,
    "C1_T29_fixed_keywords": fixed_keywords,
    "C6_fixed_text": fixed_text,
    "C4_stripped_characters": stripped_characters,
    "C3_normalized": normalized,
    "C9_without_stopwords": without_stopwords,
    "C7_C8_stop_word_share": stop_word_share,
    "C5_without_tags": without_tags,
    "C10_stemmed": stemmed,
    "C11_lemmatized": lemmatized,
    "C14_T12_script_of_words": script_of_words,
    "T1_T2_T3_W3_F12_sentences": sentence_rows,
    "A10_line_lengths": line_lengths,
    "T5_joined_sentences": joined_sentences,
    "T4_J11_attached": attached,
    "T8_T13_fixed_punctuation": fixed_punctuation,
    "T26_spaced_spans": spaced_spans,
    "T9_T10_T11_split_words": split_words,
    "T6_T17_T18_J12_W4_token_frame": token_frame,
    "T7_document_labels": document_labels,
    "T14_decoded": decoded,
    "T14_W2_decoded_by_windows": decoded_by_windows,
    "T15_C2_annotated": annotated,
    "T16_label_list": label_list,
    "A11_U4_U5_evaluation": evaluation,
    "F8_non_empty_spans": non_empty_spans,
    "O1_ordered_spans": ordered_spans,
    "F7_G6_filtered": filtered,
    "F7_X5_filtered_status": filtered_status,
    "A2_token_classes": token_classes,
    "A3_majority_class": majority_class,
    "T25_with_majority": with_majority,
    "T24_J10_overridden": overridden,
    "T28_preprocessed": preprocessed,
    "T28_preprocessed_spans": preprocessed_spans,
    "T19_split_spans": split_spans,
    "T22_trimmed_spans": trimmed_spans,
    "T20_T21_cast_texts": cast_texts,
    "T27_rebuilt": rebuilt,
    "G3_G4_J8_merged": merged,
    "G3_merged_status": merged_status,
    "G5_J7_rejected_missing": rejected_missing,
    "G1_A6_reanchored": reanchored,
    "A14_span_counts": span_counts,
    "U2_keyword_spans": keyword_spans,
}

_CORPUS = "src as (select doc_id as id, text from documents)"
_FIX = "text"
for _p, _b in ((r"\n", " "), (r"\.+", "."), (r"\t", " "), (" +", " "), (r" \.", "."), (r"\.+ ", ". ")):
    _FIX = f"regexp_replace({_FIX}, '{_p}', '{_b}', 'g')"


def _strip_characters_sql(sql: str) -> str:
    """The same steps; a look-behind becomes two passes over line breaks."""
    for pattern, by in ((r"[0-9]+\.", ""), (r"[а-яА-Я]\)", ""), ("- ", " "), (r"\A-", ""), (r"[;.–·](\n?)\z", r"\1"), (r"[^\p{L}\p{N}\n \-,()/\\!?;.]", "")):
        sql = f"regexp_replace({sql}, '{pattern}', '{by}', 'g')"
    for _ in range(2):
        sql = f"regexp_replace({sql}, '([^.])\\n', '\\1.' || chr(10), 'g')"
    return sql


_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def _sentences_sql(source: str, spans: bool = False) -> str:
    """Rows out (id, pos, offset, text): the sentences of source (id, text); with ``spans`` of (id, text, entities), whose last start may cut the last line."""
    last = "regexp_replace(s, '\\n" + _BLANK + "*\\z', '')"
    if spans:
        last = rf"case when i = max(i) over (partition by id) and lst > length({last}) - length(regexp_extract({last}, '[^\n]*\z')) then regexp_replace({last}, '([^\n]*)\z', chr(2) || '\1') else {last} end"
    before = "coalesce(sum(length({0})) over (partition by {1} rows between unbounded preceding and 1 preceding), 0)"
    return rf"""p1 as (select id, {'entities[len(entities)]."start"' if spans else 'null'} as lst, string_split(regexp_replace(text, '(\.[ \n]|\n{{3,}}|!\?)', chr(1) || '\1' || chr(1), 'g'), chr(1)) as ps from ({source}) where text is not null),
p2 as (select id, lst, unnest(ps) as s, generate_subscripts(ps, 1) as i from p1),
p3 as (select id, lst, i, s, {before.format("s", "id order by i")} as off from p2),
p4 as (select id, i, off, string_split(regexp_replace({last}, '(?m)^([А-Я][^\n]*:[^\S\n]*)$', chr(2) || '\1', 'g'), chr(2)) as hs
    from p3 where not regexp_full_match(s, '({_BLANK}|\.)*')),
p5 as (select id, i, off, unnest(hs) as s, generate_subscripts(hs, 1) as j from p4),
p6 as (select id, i, j, off + {before.format("s", "id, i order by j")} as off, s from p5),
p7 as (select id, i, j, off, s, string_split(s, chr(10)) as ls from p6 where not regexp_full_match(s, '{_BLANK}*')),
p8 as (select id, i, j, off, s, unnest(ls) as l, generate_subscripts(ls, 1) as k from p7),
p9 as (select id, i, j, off, s, l, off + coalesce(sum(length(l) + 1) over (partition by id, i, j order by k rows between unbounded preceding and 1 preceding), 0) as spot,
    avg(length(l)) filter (not regexp_full_match(l, '{_BLANK}*')) over (partition by id, i, j) as mean from p8),
flat as (select distinct id, off as "offset", s as text from p9 where mean <= 55 union all select id, spot, l from p9 where mean > 55 and not regexp_full_match(l, '{_BLANK}*')),
out as (select id, cast(row_number() over (partition by id order by "offset") - 1 as int) as pos, cast("offset" as int) as "offset", text from flat)"""


#: Spans with the sentence they belong to: att (id, k, e, pos).
_ATTACHED = """sp as (select id, unnest(entities) as e, generate_subscripts(entities, 1) as k from data where text is not null),
own as (select sp.id, k, any_value(e) as e, count(o.pos) filter (o."offset" + length(o.text) <= e."start") as place from sp left join out o on o.id = sp.id group by sp.id, k, e."start"),
att as (select id, k, e, max(place) over (partition by id order by k) as pos from own)"""

#: Token rows of the sentences with spans: tagged (id, sentence, pos, word, at, label).
_TAGGED = r"""kept as (select o.*, row_number() over (partition by o.id order by o.pos) - 1 as sentence from out o where exists (select 1 from att a where a.id = o.id and a.pos = o.pos)),
cutup as (select id, pos as sent, sentence, "offset" as base, string_split(regexp_replace(text, '([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\x0B\p{Z}])', chr(1) || '\1' || chr(1), 'g'), chr(1)) as ps from kept),
bits as (select id, sent, sentence, base, unnest(ps) as w, generate_subscripts(ps, 1) as i from cutup),
tok as (select id, sent, sentence, i // 2 - 1 as pos, w as word, base + at as at from (select *, coalesce(sum(length(w)) over (partition by id, sent order by i rows between unbounded preceding and 1 preceding), 0) as at from bits) where i % 2 = 0),
hit as (select t.id, t.sent, t.pos, arg_min(a.e, a.k) as e from tok t join att a on a.id = t.id and a.pos = t.sent and a.e."end" >= t.at group by t.id, t.sent, t.pos),
tagged as (select t.id, t.sentence, t.pos, t.word, t.at, case when h.e."start" <= t.at and t.at < h.e."end" then (case when h.e."start" = t.at then 'B-' else 'I-' end) || h.e."class" else 'O' end as label
    from tok t left join hit h on h.id = t.id and h.sent = t.sent and h.pos = t.pos)""".replace(" as at", " as spot").replace(".at", ".spot").replace("+ at ", "+ spot ")

_DECODED = """marks as (select *, case when label <> 'O' then substring(label, 3) end as kind from tagged),
runs as (select *, lag(kind) over (partition by id, sentence order by pos) as prior from marks),
isles as (select *, sum(case when kind is not null and (label[1] = 'B' or kind is distinct from prior) then 1 else 0 end) over (partition by id, sentence order by pos) as isle from runs)
select id, cast(sentence as int) as sentence, cast(min(spot) as int) as "start", cast(max(spot + length(word)) as int) as "end", kind as "class" from isles where kind is not null group by id, sentence, isle, kind"""

_SPAN_COLS = 'e."start" as "start", e."end" as "end", e."class" as "class"'
_STATUS = f"st as (select id, {strip_sql('lower(s.key)')} as value, s.value as status from (select id, unnest(map_entries(status)) as s from data where text is not null))"

ORACLE = {
    "U1_S9_U3_L1_tagged_spans": f"""with {DATA}, {_sentences_sql('select id, text from data')},
        cutup as (select id, pos as sent, "offset" as base, string_split(regexp_replace(text, '([\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\x0B\\p{{Z}}])', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as ps from out),
        bits as (select id, sent, base, unnest(ps) as w, generate_subscripts(ps, 1) as i from cutup),
        spots as (select *, base + coalesce(sum(length(w)) over (partition by id, sent order by i rows between unbounded preceding and 1 preceding), 0) as spot from bits)
        select id, cast(spot as int) as "start", cast(spot + length(w) as int) as "end", 'Latin' as "class" from spots where i % 2 = 0 and regexp_full_match(w, '[A-Z][A-Za-z]+')""",
    "C1_T29_fixed_keywords": f"select id, {strip_sql('lower(value)')} as value from keyword",
    "C6_fixed_text": f"with {_CORPUS} select id, {_FIX} as text from src",
    "C4_stripped_characters": f"with {_CORPUS} select id, {_strip_characters_sql('text')} as text from src",
    "C3_normalized": f"with {_CORPUS} select id, {_FIX.replace('(text,', '(' + _strip_characters_sql('lower(' + strip_sql('text') + ')') + ',', 1)} as norm from src",
    "T1_T2_T3_W3_F12_sentences": f"with {_CORPUS}, {_sentences_sql('select * from src')} select id, pos, \"offset\", text from out",
    "T4_J11_attached": f"with {DATA}, {_sentences_sql('select id, text, entities from data', True)}, {_ATTACHED} select o.id, o.pos, o.\"offset\", o.text, cast(count(a.k) as int) as n_spans from out o left join att a on a.id = o.id and a.pos = o.pos group by all",
    "T6_T17_T18_J12_W4_token_frame": f"with {DATA}, {_sentences_sql('select id, text, entities from data', True)}, {_ATTACHED}, {_TAGGED} select id, cast(sentence as int) as sentence, cast(pos as int) as pos, word, label from tagged",
    "T14_decoded": f"with {DATA}, {_sentences_sql('select id, text, entities from data', True)}, {_ATTACHED}, {_TAGGED}, {_DECODED}",
    "T14_W2_decoded_by_windows": f"with {DATA}, {_sentences_sql('select id, text, entities from data', True)}, {_ATTACHED}, {_TAGGED}, {_DECODED}",
    "A11_U4_U5_evaluation": f"""with {DATA}, {_sentences_sql('select id, text, entities from data', True)}, {_ATTACHED}, {_TAGGED},
        t as (select string_split(id, '-')[1] as kind, lower(word) as w, label from tagged),
        best as (select w, label as guess from (select *, row_number() over (partition by w order by n desc, label) as k from (select w, label, count(*) as n from t group by all)) where k = 1),
        c as (select kind, count(*) filter (label = guess and label <> 'O') as hits, count(*) filter (guess <> 'O') as guessed, count(*) filter (label <> 'O') as truth, count(*) as n from t join best using (w) group by kind)
        select kind, round(hits / nullif(guessed, 0)::double, 6) as precision, round(hits / nullif(truth, 0)::double, 6) as recall,
            round(2 * (hits / guessed::double) * (hits / truth::double) / nullif((hits / guessed::double) + (hits / truth::double), 0), 6) as f1, n from c""",
    "T5_joined_sentences": f"with {DATA}, {_sentences_sql('select id, text from data')} select d.id, case when d.text is not null then coalesce(string_agg(o.text, '. ' order by o.pos), '') end as text from data d left join out o using (id) group by d.id, d.text",
    "C14_T12_script_of_words": r"select id, not regexp_matches(value, '[а-яА-Я]') as english, regexp_full_match(value, '\p{P}*') as marks, regexp_full_match(value, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+') as blank from keyword",
    "A10_line_lengths": rf"""with {_CORPUS}, lines as (select id, unnest(string_split(text, chr(10))) as l from src)
        select s.id, round(avg(length(l)) filter (not regexp_full_match(l, '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]*')), 6) as mean_length from src s left join lines using (id) group by s.id""",
    "F8_non_empty_spans": f'with {DATA} select id, {_SPAN_COLS} from (select id, unnest(entities) as e from data) where e."start" < e."end"',
    "O1_ordered_spans": f"""with {DATA} select id, cast(row_number() over (partition by id order by e."start", i) - 1 as int) as pos, {_SPAN_COLS}
        from (select id, unnest(entities) as e, generate_subscripts(entities, 1) as i from data)""",
    "F7_G6_filtered": f"with {DATA}, {SPANS}, {_STATUS} select id, {_SPAN_COLS} from spans s where text is not null and not exists (select 1 from st where st.id = s.id and st.value = s.value and st.status = 'rejected')",
    "F7_X5_filtered_status": f"with {DATA}, {_STATUS} select distinct id, value, status from st where status is distinct from 'rejected'",
    "A2_token_classes": f'with {DATA}, {SPANS} select value as token, e."class" as "class", count(*) as n from spans where text is not null group by all',
    "A3_majority_class": f"""with {DATA}, {SPANS}, c as (select value as token, e."class" as "class", count(*) as n, min((id, pos)) as first from spans where text is not null group by all)
        select token, "class" from (select *, row_number() over (partition by token order by n desc, first) as k from c) where k = 1""",
    "T25_with_majority": f"""with {DATA}, {SPANS}, c as (select value as token, e."class" as "class", count(*) as n, min((id, pos)) as first from spans where text is not null group by all),
        top as (select token, "class" from (select *, row_number() over (partition by token order by n desc, first) as k from c) where k = 1)
        select s.id, e."start" as "start", e."end" as "end", t."class" as "class" from spans s join top t on t.token = s.value""",
    "T24_J10_overridden": f"""with {DATA}, {SPANS} select id, e."start" as "start", e."end" as "end",
        case when value in (select lower(name) from canon_term where type = 'ProgLanguage') then 'ProgLanguage' else e."class" end as "class" from spans where text is not null""",
    "T15_C2_annotated": f"""with {DATA}, s as (select id, text, e, row_number() over (partition by id order by e."start", i) as k from (select id, text, unnest(entities) as e, generate_subscripts(entities, 1) as i from data where text is not null)),
        p as (select *, coalesce(lag(e."end") over (partition by id order by k), 0) as spot from s),
        ends as (select d.id, any_value(d.text) as text, coalesce(arg_max(s.e."end", s.k), 0) as spot, count(s.k) as n from data d left join s using (id) where d.text is not null group by d.id)
        select id, cast(2 * k - 2 as int) as pos, substring(text, spot + 1, greatest(e."start" - spot, 0)) as text, null::varchar as "class" from p
        union all select id, cast(2 * k - 1 as int), substring(text, e."start" + 1, greatest(e."end" - e."start", 0)), e."class" from p
        union all select id, cast(2 * n as int), substring(text, spot + 1), null from ends""",
    "T16_label_list": """with l as (select 0 as o, 'O' as label union all select 1 + 2 * row_number() over (order by type), 'B-' || type from (select distinct type from canon_term)
        union all select 2 + 2 * row_number() over (order by type), 'I-' || type from (select distinct type from canon_term)) select cast(row_number() over (order by o) - 1 as int) as pos, label from l""",
    "C11_lemmatized": f"""with {DOCS} select id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\x0B\\p{{Z}}]'),
        lambda x: coalesce(map_extract(map {{{', '.join(f"'{a}': '{b}'" for a, b in _LEMMAS.items())}}}, x)[1], x)), ' ') as lemmas from docs""",
    "T9_T10_T11_split_words": r"""with w as (select id, value, length(value) - length(replace(value, ',', '')) as commas, string_split(value, ',') as segs, string_split(value, '/') as parts from keyword),
        c as (select *, len(list_filter(segs, lambda s: regexp_full_match(s, '[ \t\n\r\x0B\f]'))) as blank,
            len(list_filter(segs, lambda s: not regexp_full_match(s, '[ \t\n\r\x0B\f]') and not regexp_matches(s, '[а-яА-Я]'))) as english,
            2 * commas + 1 + length(value) - length(replace(value, ' ', '')) as words from w)
        select id, regexp_replace(value, '([;\n])', '|\1|', 'g') as semicolon,
            case when commas > 0 and (commas > 6 or english * 2.5 >= commas + 1 - blank or words <= (commas + 1 - blank) * 2.5) then replace(value, ',', '|,|') end as comma,
            case when len(parts) > 1 and len(list_filter(parts, lambda s: regexp_full_match(s, '\p{N}+'))) = 0 and len(list_filter(parts, lambda s: not regexp_matches(s, '[а-яА-Я]'))) > 0 then replace(value, '/', '|/|') end as slash
        from c""",
    "T20_T21_cast_texts": f"""with {DATA} select id, replace(replace(replace(replace(text, 'С ++', 'C++ '), 'C ++', 'c++ '), 'С' || chr(10) || '++', 'С++ '), 'C' || chr(10) || '++', 'С++ ') as text from data where text is not null""",
    "G3_G4_J8_merged": f"""with {DATA}, {SPANS}, {_STATUS} select distinct s.id, {_SPAN_COLS} from spans s where text is not null and e."start" < e."end" and (e."class" in ('Technology', 'ProgLanguage')
        or exists (select 1 from st where st.id = s.id and st.value = s.value and st.status in ('confirmed', 'rejected', 'added')))""",
    "G3_merged_status": f"""with {DATA}, {SPANS}, {_STATUS} select distinct s.id, s.value, case st.status when 'rejected' then 'rejected' else 'confirmed' end as status
        from spans s join st on st.id = s.id and st.value = s.value where e."class" in ('Technology', 'ProgLanguage') and st.status in ('confirmed', 'rejected', 'added')""",
    "G5_J7_rejected_missing": f"""with {DATA}, {SPANS}, {_STATUS}, u as (select id, value from spans where e."class" in ('Technology', 'ProgLanguage'))
        select id, {_SPAN_COLS} from spans s where text is not null and (e."class" in ('Technology', 'ProgLanguage') or (not exists (select 1 from u where u.id = s.id and u.value = s.value)
            and exists (select 1 from st where st.id = s.id and st.value = s.value and st.status in ('rejected', 'extracted', 'confirmed'))))""",
    "A14_span_counts": f"with {DATA}, {_STATUS} select d.id, cast(coalesce(len(entities), 0) as int) as n_spans, cast((select count(distinct value) from st where st.id = d.id) as int) as n_status from data d",
}
