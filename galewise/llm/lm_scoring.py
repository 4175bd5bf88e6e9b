"""Language-model scores of texts by a Kneser-Ney model of the texts that aren't held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.llm.ngram import build_model, score_texts


def score_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts with ``crc32(doc_id as text) mod folds = 0`` are held out; the model counts all others. A text's tokens are its
    words with A-Z lowered and one end. ``score`` sums log10 of the model's probabilities, ``base_score`` those of
    the smoothed word frequencies. A null or empty text is the end alone. A null id counts as the empty text and so is held
    out. Repeated rows are counted and scored each. Without training texts every probability is that of an
    unknown word. Extra columns are ignored; an empty table gives an empty result.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (fold == 0).alias("held_out"))
    model = build_model(rows.where(~F.col("held_out")).select("text"))
    out = score_texts(rows, model, extra=("held_out",)).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
