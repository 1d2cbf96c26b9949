"""Loss-model queries with their SQL oracles."""

from __future__ import annotations

from corvid.operators import lexicon as lx
from corvid.plans import loss_flow as lf
from corvid.plans import oracle as o
from corvid.plans import oracle_text as ot
from corvid.plans import q_model as qm
from corvid.plans.catalog import register

_COLUMNS = ", ".join("d.text AS circumstances_of_accident" if c == lf.TEXT else f"m.{c}" for c in lf.NOTE_COLUMNS)
_NOTES = o.with_(*o.FLOW_B) + f"SELECT {_COLUMNS} FROM master m LEFT JOIN documents d ON d.doc_id = m.claim_number"
# The text oracles read ``docs``: here one row per claim, keyed as they expect.
_DOCS = f"docs AS (SELECT claim_number AS doc_id, {ot.clean_sql(lf.TEXT)} AS t FROM ({_NOTES}))"


def matrix_sql() -> str:
    cols = ", ".join(f"coalesce(try_cast({c} AS DOUBLE), 0) AS {c}" for c in (*lf.FEATURES, lf.LABEL))
    return f"""
SELECT b.claim_number, {cols} FROM ({_NOTES}) b
JOIN ({ot.token_sql(lx.TOKEN_LEXICON).replace(ot.DOCS, _DOCS)}) t ON b.claim_number = t.doc_id
JOIN ({ot.phrase_sql(lx.PHRASE_LEXICON).replace(ot.DOCS, _DOCS)}) p ON b.claim_number = p.doc_id"""


def folds_sql() -> str:
    return qm.folds_sql(f"SELECT claim_number, {lf.LABEL} FROM ({_NOTES})", "claim_number", lf.LABEL)


@register("loss_notes", f"SELECT * FROM ({_NOTES}) WHERE {lf.TEXT} IS NOT NULL")
def loss_notes(spark, d):
    """PJ7 (notes variant) + DQ1 + FL6."""
    return lf.notes(spark, d)


@register("loss_matrix", matrix_sql)
def loss_matrix(spark, d):
    """FL15 + TX1 + TX8-TX13 + FM1 on the loss flow."""
    return lf.matrix(spark, d)


@register("loss_class_subsets", o.with_(*o.FLOW_B) + """
SELECT 'ft_large_loss1' AS flag, ft_large_loss1 AS value, count(*) AS n FROM master GROUP BY ft_large_loss1
UNION ALL SELECT 'ft_large_loss2', ft_large_loss2, count(*) FROM master GROUP BY ft_large_loss2""")
def loss_class_subsets(spark, d):
    """FL10 for both flags."""
    return lf.class_subsets(spark, d)


@register("loss_scores", lambda: qm.gnb_sql(qm.SCORES_TAIL, matrix_sql(), folds_sql(), lf.FEATURES, lf.LABEL, "claim_number"))
def loss_scores(spark, d):
    """The loss model end to end, scored with Gaussian naive Bayes over five folds."""
    return lf.scores(spark, d)
