"""SQL oracles for the text operators, generated from the same config.

The token oracle explodes tokens with their positions and uses ``lag`` /
``lead``; the phrase oracle finds non-overlapping occurrences by splitting
the text on the literal phrase (part lengths give the starts), so neither
repeats the Spark formulation.
"""

from __future__ import annotations

from collections.abc import Sequence

from corvid.operators import lexicon as lx


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words: Sequence[str]) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def clean_sql(col: str) -> str:
    return (f"lower(regexp_replace(regexp_replace(coalesce({col}, 'no note'), "
            f"'[^a-zA-Z0-9.]', ' ', 'g'), ' +', ' ', 'g'))")


DOCS = f"docs AS (SELECT doc_id, {clean_sql('text')} AS t FROM documents)"


def token_sql(lexicon: Sequence[lx.TokenKey]) -> str:
    mapping = lx.synonym_map(lexicon)
    values = ", ".join(f"({q(w)}, {q(k)})" for w, k in sorted(mapping.items()))
    pat = q(lx.TOKEN_PATTERN)
    feats = []
    for e in sorted(lexicon, key=lambda e: e.key):
        if e.negations:
            n = abs(e.offset)
            fn = "lag" if e.offset < 0 else "lead"
            neighbour = f"{fn}(w, {n}) OVER (PARTITION BY doc_id ORDER BY pos)"
            feats.append((e.key, neighbour, in_list(e.negations)))
        else:
            feats.append((e.key, None, None))
    lag_cols = ", ".join(f"{nb} AS nb_{k}" for k, nb, _ in feats if nb) or "NULL AS nb_none"
    outs = []
    for k, nb, negs in feats:
        if nb:
            outs.append(f"coalesce(max(CASE WHEN w = {q(k)} THEN CASE WHEN nb_{k} IN {negs} "
                        f"THEN -1 ELSE 1 END END), 0) AS {k}")
        else:
            outs.append(f"coalesce(max(CASE WHEN w = {q(k)} THEN 1 END), 0) AS {k}")
    return f"""WITH {DOCS},
toks AS (SELECT doc_id, unnest(regexp_extract_all(t, {pat})) AS tok,
                generate_subscripts(regexp_extract_all(t, {pat}), 1) AS pos FROM docs),
syn(word, key) AS (VALUES {values}),
norm AS (SELECT doc_id, pos, coalesce(syn.key, tok) AS w FROM toks LEFT JOIN syn ON tok = syn.word),
lagged AS (SELECT doc_id, w, {lag_cols} FROM norm)
SELECT d.doc_id, {", ".join(outs)}
FROM docs d LEFT JOIN lagged l ON d.doc_id = l.doc_id GROUP BY d.doc_id"""


def _occurrences(phrase: str, tag: str) -> str:
    """Start offsets (0-based) of non-overlapping occurrences of a literal."""
    n = len(phrase)
    return f"""SELECT doc_id, {q(tag)} AS tag, {n} AS len,
       sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)
         + (k - 1) * {n} AS start, k, parts_n
FROM (SELECT doc_id, unnest(string_split(t, {q(phrase)})) AS part,
             generate_subscripts(string_split(t, {q(phrase)}), 1) AS k,
             len(string_split(t, {q(phrase)})) AS parts_n FROM docs)"""


def phrase_sql(lexicon: Sequence[lx.PhraseKey]) -> str:
    ctes, outs = [DOCS], []
    for e in sorted(lexicon, key=lambda e: e.key):
        if not e.exclude:
            cond = " OR ".join(f"contains(t, {q(p)})" for p in dict.fromkeys(e.include))
            outs.append(f"CASE WHEN {cond} THEN 1 ELSE 0 END AS {e.key}")
            continue
        inc = " UNION ALL ".join(_occurrences(p, "i") for p in dict.fromkeys(e.include))
        exc = " UNION ALL ".join(_occurrences(x, "x") for x in dict.fromkeys(e.exclude))
        ctes.append(f"""inc_{e.key} AS (SELECT doc_id, start FROM ({inc}) WHERE k < parts_n)""")
        ctes.append(f"""exc_{e.key} AS (SELECT doc_id, start, len FROM ({exc}) WHERE k < parts_n)""")
        ctes.append(f"""hit_{e.key} AS (
  SELECT DISTINCT i.doc_id FROM inc_{e.key} i
  WHERE NOT EXISTS (SELECT 1 FROM exc_{e.key} x WHERE x.doc_id = i.doc_id
                    AND x.start <= i.start AND i.start <= x.start + x.len))""")
        outs.append(f"CASE WHEN d.doc_id IN (SELECT doc_id FROM hit_{e.key}) THEN 1 ELSE 0 END AS {e.key}")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT d.doc_id, {', '.join(outs)} FROM docs d"
