"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import fresh_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))[0]


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .orc_output import digests, read_orc, write_orc

    path = fresh_path(spark, "token-ids")
    write_orc(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return digests(read_orc(spark, path))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with known licence sentences."""
    from pyspark.sql import functions as F

    from .licenses import scan

    found = scan(table(spark, sf_dir, "documents")).filter(F.size("sentence_ids") > 0)
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .chat import digests, format_chat, text_part

    planted = spark.sql(r"SELECT * FROM VALUES (-7L, 0L, 'user', r'\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return digests(format_chat(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digests, repeats

    return digests(repeats(table(spark, sf_dir, "documents")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item and the words that agree."""
    from .decontaminate import contaminations

    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op4_token_counts, op9_orc_token_ids, op10_simhash_near_dedup, op2_quality_rules, op6_license_scan, op7_chat_format, op5_suffix_dedup, op3_benchmark_decontamination, op8_html_extraction)
}

def _op7_sql() -> str:
    from .chat import END, SAYS, TURN

    text = "coalesce(text, '')"
    marks = len(TURN) + len(SAYS) + len(END)
    longer = f"{marks} + length(r) + length(t) + length(r) - length(replace(replace(r, '\\', ''), '<', '')) + length(t) - length(replace(replace(t, '\\', ''), '<', ''))"
    return f"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS r, {text} AS t FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
      coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
      sum({longer})::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id"""


def _op6_sql() -> str:
    from .licenses import ALL_RULES, CANONICAL, CODES, KNOWN, LEADER, LINE_END, SENTENCE_END, SPDX, pattern, taken_first

    def held(name: str, of: list[str]) -> str:
        rest = "s"
        for longer in taken_first(name, of, ALL_RULES):
            rest = f"regexp_replace({rest}, '{longer}', '', 'g')"
        return f"CASE WHEN regexp_matches({rest}, '{pattern(of)}') THEN '{name}' END"

    known = ", ".join(f"('{sentence}', '{i}', '{CODES[i]}')" for sentence, i in KNOWN.items())
    bare = f"regexp_replace(line, '{LEADER}', '')"
    tagged = f"regexp_replace(regexp_replace({bare}, '{SPDX}', '\nspdx license identifier '), ' +(OR|AND|WITH) +', '\n\nspdx license identifier ', 'g') || '\n'"
    cut = lambda way, of, end: f"SELECT doc_id, nth, {way} AS way, generate_subscripts(c, 1) AS k, trim(regexp_replace(lower(unnest(c)), '[^a-z0-9]+', ' ', 'g')) AS said FROM (SELECT doc_id, nth, regexp_split_to_array({of}, '{end}') AS c FROM paragraphs)"
    names = ", ".join(f"'{n}'" for n in dict.fromkeys(n for n, _ in ALL_RULES))
    alike = "said"
    for old, new in CANONICAL:
        alike = f"regexp_replace({alike}, '{old}', '{new}', 'g')"
    return f"""
    WITH known(sentence, id, code) AS (VALUES {known}),
    lines AS (SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS line FROM (SELECT doc_id, string_split(replace(text, '\r', ''), '\n') AS c FROM documents)),
    joined AS (SELECT doc_id, replace(string_agg(CASE WHEN regexp_matches({bare}, '{SPDX}') THEN {tagged} ELSE {bare} END, '\n' ORDER BY i), ':\n', ':\n\n') AS t FROM lines GROUP BY doc_id),
    paragraphs AS (SELECT doc_id, generate_subscripts(c, 1) AS nth, unnest(c) AS p FROM (SELECT doc_id, regexp_split_to_array(t, '\n\n+') AS c FROM joined)),
    sentences AS ({cut(0, "replace(p, '\n', ' ')", SENTENCE_END)} UNION ALL {cut(1, "p", LINE_END)}),
    found AS (SELECT doc_id, nth, way, k, coalesce(a.id, b.id) AS id, coalesce(a.code, b.code) AS code FROM sentences LEFT JOIN known a ON said = a.sentence
      LEFT JOIN known b ON {alike} = b.sentence WHERE a.id IS NOT NULL OR b.id IS NOT NULL),
    ways AS (SELECT doc_id, nth, arg_max(way, (n, -way)) AS way FROM (SELECT doc_id, nth, way, count(*) AS n FROM found GROUP BY ALL) GROUP BY doc_id, nth),
    held AS (SELECT doc_id, sentence_ids, list_distinct([{", ".join(held(*r) for r in ALL_RULES)}]) AS h
      FROM (SELECT doc_id, string_agg(id, ',' ORDER BY nth, k) AS sentence_ids, string_agg(code, '' ORDER BY nth, k) AS s FROM found JOIN ways USING (doc_id, nth, way) GROUP BY doc_id))
    SELECT doc_id, sentence_ids, array_to_string(list_filter([{names}], lambda x: list_contains(h, x)), ',') AS licenses FROM held""".replace("\\z", "$")


def _op2_sql() -> str:
    from .quality import FEW, RATIOS, SPREAD, WEIGHT

    word = r"[^\x20\x09-\x0D]+"
    floor = lambda b: f"(CASE WHEN {b} < 16 THEN {b} ELSE ({b} % 16 + 16) << greatest({b} // 16 - 1, 0)::INT END)::BIGINT"
    shrunk = lambda x, y: ", ".join(f"({x}.n * {x}.q{k} + greatest({WEIGHT} - {x}.n, 0) * {y}.q{k}) // greatest({x}.n, {WEIGHT}) AS q{k}" for k in (1, 2, 3))
    cut = lambda x, ratio: f"LEFT JOIN cuts {x} ON {x}.ratio = '{ratio}' AND {x}.lang IS NOT DISTINCT FROM r.lang AND {x}.source IS NOT DISTINCT FROM r.source"
    rate = lambda n, x, of: f"greatest({n} - {FEW}, 0) * 1000000 <= {x}.high * greatest({of}, 1)"
    level = lambda by: f"""SELECT {by} ratio, max(total)::BIGINT AS n, {", ".join(floor(f"min(bucket) FILTER (WHERE 4 * upto >= {k} * total)") + f" AS q{k}" for k in (1, 2, 3))}
      FROM (SELECT {by} ratio, bucket, sum(n) OVER (PARTITION BY {by} ratio ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by} ratio) AS total
        FROM (SELECT {by} ratio, bucket, sum(n) AS n FROM sketch GROUP BY {by} ratio, bucket)) GROUP BY {by} ratio"""  # noqa: E731
    return f"""
    WITH words AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT doc_id, regexp_extract_all(text, '{word}') AS w FROM documents)),
    windows AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d || ' ' || lead(w, 3) OVER d || ' ' || lead(w, 4) OVER d AS five FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM windows WHERE five IS NOT NULL) WHERE n > 1),
    repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) r(k) GROUP BY doc_id),
    echoes AS (SELECT doc_id, count(*) FILTER (WHERE w = before) AS n_echo_words FROM (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM words) GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '{word}') GROUP BY doc_id),
    counts AS (
      SELECT d.doc_id, lang, source, coalesce(len(regexp_extract_all(text, '{word}')), 0)::BIGINT AS n_words, coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
        coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_echo_words, 0)::BIGINT AS n_echo_words
      FROM documents d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN echoes USING (doc_id)),
    ratios AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols * 1000000 // greatest(word_chars, 1) AS symbols,
      word_chars * 1000 // greatest(n_words, 1) AS word_length, n_dup_lines * 1000000 // greatest(n_words, 1) AS lines, n_echo_words * 1000000 // greatest(n_words, 1) AS echoes FROM counts),
    sketch AS (SELECT lang, source, ratio, CASE WHEN v < 16 THEN v ELSE 16 * (length(bin(v)) - 5) + (v >> greatest(length(bin(v)) - 5, 0)::INT) END AS bucket, count(*) AS n
      FROM (SELECT lang, source, unnest([{", ".join(f"'{r}'" for r in RATIOS)}]) AS ratio, unnest([{", ".join(RATIOS)}]) AS v FROM ratios WHERE NOT base_failed) GROUP BY ALL),
    own AS ({level("lang, source,")}), langs AS ({level("lang,")}), every AS ({level("")}),
    wide AS (SELECT l.lang, l.ratio, {shrunk("l", "a")} FROM langs l JOIN every a ON l.ratio = a.ratio),
    narrow AS (SELECT o.lang, o.source, o.ratio, {shrunk("o", "w")} FROM own o JOIN wide w ON o.lang IS NOT DISTINCT FROM w.lang AND o.ratio = w.ratio),
    usual AS (SELECT ratio, quantile_disc(q3 - q2, 0.5) AS up FROM narrow GROUP BY ratio),
    cuts AS (SELECT lang, source, ratio, q2, q2 - greatest({SPREAD} * (q2 - q1), q2 // 2) AS low, q2 + {SPREAD} * least(q3 - q2, greatest(q2 - q1, up)) AS high FROM narrow JOIN usual USING (ratio))
    SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND coalesce({rate("n_symbols", "s", "word_chars")} AND {rate("n_dup_lines", "n", "n_words")} AND {rate("n_echo_words", "e", "n_words")}
        AND word_length BETWEEN w.low AND greatest(w.high, w.q2 + w.q2 // 2), false) AS kept, n_echo_words
    FROM ratios r {cut("s", "symbols")} {cut("w", "word_length")} {cut("n", "lines")} {cut("e", "echoes")}"""


SQL: dict[str, str] = {"op2_quality_rules": _op2_sql(), "op6_license_scan": _op6_sql(), "op7_chat_format": _op7_sql()}
