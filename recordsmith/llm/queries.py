"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import align_tokenizers
from .collocations import collocations
from .common import table
from .decontamination import contaminated
from .language_id import document_rows, identify, page_rows, train
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .neighbours import nearest_neighbours
from .packing import pack_documents
from .quality_classifier import classify
from .quality_rules import quality_rules
from .simhash import simhash_components
from .substring_dedup import repeated_passages, repeated_within
from .token_counts import count_tokens


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"), counts=("n_lines", "n_deleted"))
    return done.select("doc_id", "n_lines", "n_deleted", "text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(document_rows(docs), train(docs), keep=("doc_id",))


def op6_pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages, which have declared languages and addresses."""
    return identify(page_rows(table(spark, sf_dir, "pages")), train(table(spark, sf_dir, "documents")), keep=("page_id",))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_within_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats inside one document, which the passages between documents leave out."""
    return repeated_within(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_line_dedup,
        op3_best_fit_packing,
        op4_simhash_near_dedup,
        op5_benchmark_decontamination,
        op6_language_id,
        op6_pages_language_id,
        op7_token_counts,
        op8_substring_dedup,
        op8_within_documents,
        op9_quality_rules,
        op10_quality_classifier,
        op11_approximate_neighbours,
        op12_phrase_collocations,
        op13_cross_tokenizer_alignment,
    )
}

_TRIM = r"regexp_replace({}, '^[ \t\r\x0B\x0C]+|[ \t\r\x0B\x0C]+$', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), filled AS (
  SELECT doc_id, pos, {_TRIM.format('line')} AS t,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS j, count(*) OVER (PARTITION BY doc_id) AS m
  FROM lines WHERE {_TRIM.format('line')} <> ''
), runs AS (
  SELECT doc_id, j, m,
         CASE WHEN m >= 3 THEN concat('3:', t, chr(10), lead(t, 1) OVER d, chr(10), lead(t, 2) OVER d)
              ELSE concat(m, ':', string_agg(t, chr(10)) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS run
  FROM filled WINDOW d AS (PARTITION BY doc_id ORDER BY j)
), placed AS (
  SELECT *, first_value(doc_id) OVER r AS first_doc, first_value(j) OVER r AS first_j
  FROM runs WHERE j <= m - 3 OR (m < 3 AND j = 0)
  WINDOW r AS (PARTITION BY run ORDER BY doc_id, j)
), later AS (
  SELECT doc_id, j, least(m, 3) AS n FROM placed WHERE first_doc <> doc_id OR j >= first_j + 3
), gone AS (
  SELECT DISTINCT f.doc_id, f.pos FROM filled f JOIN later l ON f.doc_id = l.doc_id AND f.j BETWEEN l.j AND l.j + l.n - 1
)
SELECT l.doc_id, count(*) FILTER (WHERE {_TRIM.format('l.line')} <> '') AS n_lines, count(g.pos) AS n_deleted,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
GROUP BY l.doc_id
HAVING count(g.pos) = 0 OR count(g.pos) < count(*) FILTER (WHERE {_TRIM.format('l.line')} <> '')
""",
    "op12_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, k, phrase, f AS a FROM f WHERE k > 1 AND f >= 100
), inner_ AS (
  SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN cand b ON b.lang = c.lang AND b.k > c.k AND contains(concat(' ', b.phrase, ' '), concat(' ', c.phrase, ' ')) AND 100 * b.a >= 100 * c.a
), cuts AS (
  SELECT c.*, unnest(range(1, c.k)) AS cut FROM cand c ANTI JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase
), parts AS (
  SELECT *, array_to_string(string_split(phrase, ' ')[1 : cut], ' ') AS left_, array_to_string(string_split(phrase, ' ')[cut + 1 : k], ' ') AS right_ FROM cuts
), scored AS (
  SELECT p.lang, p.phrase, p.cut, p.a, x.f AS l, y.f AS r, t.n, CAST((1000::HUGEINT * p.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.left_ JOIN f y ON y.lang = p.lang AND y.phrase = p.right_ JOIN totals t ON t.lang = p.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM best QUALIFY rank <= 2000
""",
}
