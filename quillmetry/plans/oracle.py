"""The same queries as SQL for DuckDB, written on their own from the definitions."""

from __future__ import annotations

from quillmetry import constants as C
from quillmetry.functions.text import LINK, SPACE, TOKEN, WORD

_SPLIT = f"list_filter(string_split(regexp_replace(text, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_STRIP = f"'^{SPACE}+|{SPACE}+$'"


def _in(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def _pick(index: str, values: str) -> str:
    return f"([{', '.join(repr(v) for v in values.split())}])[({index}) + 1]"


def _suffix(t: str) -> str:
    cases = " ".join(f"WHEN length({t}) > {len(s)} AND ends_with({t}, '{s}') AND regexp_matches(left({t}, length({t}) - {len(s)}), '[א-ת]') THEN '{s}'" for s in C.SUFFIXES)
    return f"CASE WHEN {t} IN {_in(C.SUFFIXES)} THEN NULL {cases} END"


def _prefix(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '^[{C.PREFIX_LETTERS}][א-ת]') THEN left({t}, 1) END"


_TOKENS = f"""
sl AS (SELECT doc_id, {_SPLIT} AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(l) AS sent, generate_subscripts(l, 1) - 1 AS sent_idx FROM sl),
sk AS (SELECT doc_id, sent_idx, sent, regexp_extract_all(sent, '{TOKEN}') || CASE WHEN right(sent, 1) IN ('.', '!', '?', ':') THEN [right(sent, 1)] ELSE []::VARCHAR[] END AS toks FROM s),
t0 AS (SELECT doc_id, sent_idx, unnest(toks) AS surface, generate_subscripts(toks, 1) AS i FROM sk),
t AS (SELECT doc_id, sent_idx, i, surface, lower(left(surface, 4)) AS lemma,
  CASE WHEN surface IN ('.', '!', '?', ':') THEN 'PUNCT' ELSE {_pick('length(surface) % 7', 'NOUN VERB NOUN ADJ ADV PRON ADP')} END AS pos,
  CASE WHEN i % 5 <> 0 THEN {_pick('i % 2', 'M F')} END AS gender, CASE WHEN i % 3 = 0 THEN 'P' ELSE 'S' END AS number,
  CASE WHEN i = 1 THEN 'root' ELSE {_pick('i % 6', 'nsubj amod ccomp advcl obj rcmod')} END AS deprel, i // 2 AS head, 1 + length(surface) % 9 AS ambiguity FROM t0),
tb AS (SELECT *, CASE WHEN pos = 'VERB' THEN {_pick('i % 4', 'PAAL NIFAL PIEL HIFIL')} END AS binyan FROM t)"""

_FEATURES = (
    _TOKENS
    + f""",
sn AS (SELECT sk.doc_id, sk.sent_idx, count(tb.i) AS n, bool_or(coalesce(tb.surface IN {_in(C.TERMINAL_MARKS)}, false)) AS closed, coalesce(list_sort(list(DISTINCT tb.lemma) FILTER (tb.lemma IS NOT NULL)), []) AS lemmas
  FROM sk LEFT JOIN tb USING (doc_id, sent_idx) GROUP BY ALL),
sd AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE floor(log2(n) + 1e-9) + 1 END AS depth, lag(lemmas) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS before FROM sn),
fs AS (SELECT doc_id, count(*)::DOUBLE AS s, sum(n)::DOUBLE AS n, avg(depth) AS avg_tree_depth, max(depth)::DOUBLE AS max_tree_depth, coalesce(var_samp(n), 0) AS sentence_length_variance,
  avg((n > {C.LONG_SENTENCE})::INT) AS long_sentence_ratio, avg((n < {C.SHORT_SENTENCE})::INT) AS short_sentence_ratio, avg((NOT closed)::INT) AS missing_terminal_punctuation_ratio,
  CASE WHEN count(*) >= 2 THEN regr_slope(n, sent_idx) ELSE 0 END AS sentence_length_trend,
  coalesce(avg(CASE WHEN before IS NOT NULL THEN len(list_intersect(before, lemmas)) / greatest(len(list_distinct(list_concat(before, lemmas))), 1) END), 0) AS sentence_overlap FROM sd GROUP BY doc_id),
ag AS (SELECT a.doc_id, avg((coalesce(a.gender <> h.gender, false) OR coalesce(a.number <> h.number, false))::INT) AS agreement_error_rate FROM tb a JOIN tb h ON a.doc_id = h.doc_id AND a.sent_idx = h.sent_idx AND h.i = a.head WHERE a.deprel IN {_in(C.AGREEMENT_RELATIONS)} GROUP BY 1),
co AS (SELECT doc_id, count(*) AS construct FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id, sent_idx ORDER BY i) AS nxt FROM tb) WHERE pos = 'NOUN' AND nxt = 'NOUN' GROUP BY 1),
ent AS (SELECT doc_id, kind, -sum(p * ln(p)) AS e FROM (SELECT doc_id, kind, c / sum(c) OVER (PARTITION BY doc_id, kind) AS p FROM (SELECT doc_id, 'b' AS kind, binyan AS v, count(*) AS c FROM tb WHERE binyan IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id, 'd', deprel, count(*) FROM tb GROUP BY ALL)) GROUP BY ALL),
hx AS (SELECT doc_id, count(*) FILTER (c = 1) AS hapax, count(*) AS kinds FROM (SELECT doc_id, surface, count(*) AS c FROM tb GROUP BY ALL) GROUP BY 1),
ft AS (SELECT doc_id, avg((pos = 'VERB')::INT) AS verb_ratio, avg(({_prefix('surface')} IS NOT NULL)::INT) AS prefix_density, avg(({_suffix('surface')} IS NOT NULL)::INT) AS suffix_pronoun_ratio, avg(ambiguity) AS morphological_ambiguity,
  avg(abs(i - head)) AS avg_dependency_distance, count(*) FILTER (deprel IN {_in(C.CLAUSE_RELATIONS)}) AS clauses, count(*) FILTER (deprel IN {_in(C.SUBORDINATE_RELATIONS)}) AS sub, count(*) FILTER (deprel = 'root') AS roots,
  coalesce(avg((i > head)::INT) FILTER (head > 0), 0) AS right_branching_ratio, coalesce(var_samp(abs(i - head)) FILTER (head > 0), 0) AS dependency_distance_variance, avg(length(surface)) AS avg_token_length,
  count(DISTINCT lemma) AS lemmas, avg((pos IN {_in(C.CONTENT_POS)})::INT) AS content_word_ratio, avg((pos = 'PUNCT')::INT) AS punctuation_ratio, count(*) FILTER (surface IN {_in(C.CONNECTIVES)}) AS connectives,
  avg((pos = 'PRON')::INT) / (avg((pos = 'NOUN')::INT) + {C.EPSILON}) AS pronoun_to_noun_ratio FROM tb GROUP BY 1),
ps AS (SELECT doc_id, sent_idx, pos, count(*) / any_value(n) AS x FROM tb JOIN sn USING (doc_id, sent_idx) GROUP BY ALL),
pv AS (SELECT doc_id, avg(v) AS pos_distribution_variance FROM (SELECT doc_id, pos, CASE WHEN any_value(fs.s) >= 2 THEN (sum(x * x) - sum(x) * sum(x) / any_value(fs.s)) / (any_value(fs.s) - 1) ELSE 0 END AS v FROM ps JOIN fs USING (doc_id) GROUP BY ALL) GROUP BY 1),
fd AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS token FROM training_records) GROUP BY 1),
rw AS (SELECT doc_id, avg((coalesce(cnt, 0) < {C.RARE_COUNT})::INT) AS r FROM tb LEFT JOIN fd ON fd.token = tb.lemma GROUP BY 1),
f AS (SELECT d.doc_id, coalesce(verb_ratio, 0)::DOUBLE AS verb_ratio, coalesce(prefix_density, 0)::DOUBLE AS prefix_density, coalesce(suffix_pronoun_ratio, 0)::DOUBLE AS suffix_pronoun_ratio, coalesce(morphological_ambiguity, 0)::DOUBLE AS morphological_ambiguity,
  coalesce(agreement_error_rate, 0)::DOUBLE AS agreement_error_rate, coalesce(eb.e, 0)::DOUBLE AS binyan_entropy, coalesce(construct / n, 0)::DOUBLE AS construct_ratio, coalesce(n / s, 0)::DOUBLE AS avg_sentence_length, coalesce(avg_tree_depth, 0)::DOUBLE AS avg_tree_depth,
  coalesce(max_tree_depth, 0)::DOUBLE AS max_tree_depth, coalesce(avg_dependency_distance, 0)::DOUBLE AS avg_dependency_distance, coalesce(clauses / s, 0)::DOUBLE AS clauses_per_sentence, coalesce(sub / nullif(sub + roots, 0), 0)::DOUBLE AS subordinate_clause_ratio,
  coalesce(right_branching_ratio, 0)::DOUBLE AS right_branching_ratio, coalesce(dependency_distance_variance, 0)::DOUBLE AS dependency_distance_variance, coalesce(ed.e, 0)::DOUBLE AS clause_type_entropy, coalesce(kinds / n, 0)::DOUBLE AS type_token_ratio, coalesce(hapax / n, 0)::DOUBLE AS hapax_ratio,
  coalesce(avg_token_length, 0)::DOUBLE AS avg_token_length, coalesce(lemmas / n, 0)::DOUBLE AS lemma_diversity, coalesce(rw.r, 0)::DOUBLE AS rare_word_ratio, coalesce(content_word_ratio, 0)::DOUBLE AS content_word_ratio, coalesce(sentence_length_variance, 0)::DOUBLE AS sentence_length_variance,
  coalesce(long_sentence_ratio, 0)::DOUBLE AS long_sentence_ratio, coalesce(punctuation_ratio, 0)::DOUBLE AS punctuation_ratio, coalesce(short_sentence_ratio, 0)::DOUBLE AS short_sentence_ratio, coalesce(missing_terminal_punctuation_ratio, 0)::DOUBLE AS missing_terminal_punctuation_ratio,
  coalesce(connectives / s, 0)::DOUBLE AS connective_ratio, coalesce(sentence_overlap, 0)::DOUBLE AS sentence_overlap, coalesce(pronoun_to_noun_ratio, 0)::DOUBLE AS pronoun_to_noun_ratio, coalesce(sentence_length_trend, 0)::DOUBLE AS sentence_length_trend, coalesce(pos_distribution_variance, 0)::DOUBLE AS pos_distribution_variance
  FROM documents d LEFT JOIN fs USING (doc_id) LEFT JOIN ft USING (doc_id) LEFT JOIN ag USING (doc_id) LEFT JOIN co USING (doc_id) LEFT JOIN hx USING (doc_id) LEFT JOIN pv USING (doc_id) LEFT JOIN rw USING (doc_id)
  LEFT JOIN ent eb ON eb.doc_id = d.doc_id AND eb.kind = 'b' LEFT JOIN ent ed ON ed.doc_id = d.doc_id AND ed.kind = 'd')"""
)


def _stats(source: str) -> str:
    """Baseline of the long rows (feature, value) of a FROM clause."""
    return f"""
v AS (SELECT feature, value FROM {source} WHERE value IS NOT NULL AND NOT isnan(value)),
q AS (SELECT feature, quantile_cont(value, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS p FROM v GROUP BY 1),
st0 AS (SELECT feature, avg(least(greatest(value, p[1]), p[7])) AS mean, stddev_pop(least(greatest(value, p[1]), p[7])) AS sd, min(value) AS min, max(value) AS max, any_value(p) AS p, count(*) AS valid_count FROM v JOIN q USING (feature) GROUP BY 1),
st AS (SELECT feature, mean, CASE WHEN sd < 1e-12 THEN 0.0 ELSE sd END AS std, min, max, p[2] AS p10, p[3] AS p25, p[4] AS p50, p[5] AS p75, p[6] AS p90, valid_count, valid_count < 30 AS unstable, sd < 1e-12 AS degenerate FROM st0)"""


_DOC_STATS = _FEATURES + "," + _stats("(UNPIVOT f ON COLUMNS(* EXCLUDE doc_id) INTO NAME feature VALUE value)")


def _round(columns: str, places: int = 6) -> str:
    """Rounded columns; as in the queries, 2e-9 keeps halves of the last place from falling either way."""
    bias = " + 2e-9" if places == 6 else ""
    return ", ".join(f"round({c}{bias}, {places}) + 0.0 AS {c}" for c in columns.split())


_STAT_COLUMNS = "mean std min max p10 p25 p50 p75 p90"
_STAT_SELECT = f"SELECT feature, {_round(_STAT_COLUMNS)}, valid_count, unstable, degenerate FROM st"


def _soft(value: str, f: str) -> str:
    mean, std = f"coalesce({f}.mean, 0.5)", f"coalesce({f}.std, 1.0)"
    return f"(CASE WHEN {std} = 0 THEN 0.5 ELSE 1 / (1 + exp(-(({value}) - {mean}) / {std})) END)"


def _stable(*stats: str) -> str:
    degenerate = " OR ".join(f"coalesce({s}.degenerate, false)" for s in stats)
    unstable = " OR ".join(f"coalesce({s}.unstable, true)" for s in stats)
    return f"(CASE WHEN {degenerate} THEN 0.0 WHEN {unstable} THEN 0.5 ELSE 1.0 END)"


def _document_issue(kind: str, group: str, parts) -> str:
    terms = []
    for k, (feature, weight, inverted) in enumerate(parts):
        score = _soft(f"f.{feature}", f"s{k}")
        if kind == "sentence_progression_drift":
            score = f"2 * abs({score} - 0.5)"
        terms.append(f"{weight} * coalesce({'1 - ' if inverted else ''}{score}, 0.5)")
    present = " + ".join(f"(f.{feature} IS NOT NULL)::INT" for feature, _, _ in parts)
    joins = " ".join(f"LEFT JOIN st s{k} ON s{k}.feature = '{feature}'" for k, (feature, _, _) in enumerate(parts))
    severity = " + ".join(terms)
    return f"SELECT f.doc_id, {C.EMISSION[kind]} AS emission, 0 AS place, '{kind}' AS type, '{group}' AS issue_group, {severity} AS severity, ({severity}) * ({present}) / {len(parts)} * {_stable(*(f's{k}' for k in range(len(parts))))} AS confidence, '0-' || coalesce(c.n, 0) AS span FROM f LEFT JOIN nsent c USING (doc_id) {joins} WHERE ({present}) > 0"


_SENTENCE_ISSUE = f"""SELECT doc_id, {C.EMISSION['sentence_complexity']}, sent_idx, 'sentence_complexity', 'syntax', 0.6 * {_soft('sd.n', 's0')} + 0.4 * {_soft('greatest(sd.depth - 1, 0)', 's1')}, (0.6 * {_soft('sd.n', 's0')} + 0.4 * {_soft('greatest(sd.depth - 1, 0)', 's1')}) * {_stable('s0', 's1')}, sent_idx::VARCHAR
 FROM sd LEFT JOIN st s0 ON s0.feature = 'avg_sentence_length' LEFT JOIN st s1 ON s1.feature = 'avg_tree_depth'"""
_ALIKE = "len(list_intersect(before, lemmas)) / greatest(len(list_distinct(list_concat(before, lemmas))), 1)"
_PAIR_ISSUE = f"""SELECT doc_id, {C.EMISSION['weak_cohesion']}, sent_idx, 'weak_cohesion', 'discourse', 1 - {_soft(_ALIKE, 's0')}, (1 - {_soft(_ALIKE, 's0')}) * {_stable('s0')}, (sent_idx - 1) || '-' || sent_idx
 FROM sd LEFT JOIN st s0 ON s0.feature = 'sentence_overlap' WHERE before IS NOT NULL"""
_ISSUES = (
    _DOC_STATS
    + ", nsent AS (SELECT doc_id, count(*) AS n FROM sd GROUP BY 1), iss0 AS ("
    + " UNION ALL ".join([*(_document_issue(*x) for x in C.ISSUES), _SENTENCE_ISSUE, _PAIR_ISSUE])
    + "), iss AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY emission, place) - 1 AS emit_order, avg(severity) OVER (PARTITION BY doc_id, issue_group) AS group_score FROM iss0)"
)


def _norm(x: str, low: float, high: float) -> str:
    return f"greatest(0.0, least(1.0, (({x}) - {low}) / ({high - low})))"


def _normalized(f: str) -> str:
    return _norm(f, *C.RANGES[f]) if f in C.RANGES else f


_SCORES = ", ".join(
    [
        "doc_id",
        "greatest(0, least(1, " + " + ".join(f"{w} * {_normalized(f)}" for f, w in C.DIFFICULTY_WEIGHTS.items()) + ")) AS difficulty",
        " + ".join(f"{w} * " + (_norm("abs(sentence_length_trend)", 0.0, C.RANGES[f][1]) if f == "sentence_length_trend" else _normalized(f)) for f, w in C.STYLE_WEIGHTS.items()) + " AS style",
        f"greatest(0, least(1, (punctuation_ratio + 1 - {_normalized('sentence_length_variance')} + 1 - {_normalized('pos_distribution_variance')}) / 3)) AS fluency",
        f"greatest(0, least(1, 0.4 * {_normalized('connective_ratio')} + 0.3 * {_normalized('sentence_overlap')} + 0.3 * (1 - {_normalized('pronoun_to_noun_ratio')}))) AS cohesion",
        f"greatest(0, least(1, (binyan_entropy + {_normalized('agreement_error_rate')} + {_normalized('pos_distribution_variance')} + {_normalized('clause_type_entropy')} + construct_ratio * 0.5) / 5)) AS complexity",
    ]
)


def _diagnosis(order: int, kind: str, threshold: float, parts) -> str:
    terms, types = [], []
    for w, how, key in parts:
        if how == "score":
            terms.append(f"{w} * coalesce(any_value(sc.{key}), 0)")
        else:
            types.append(key)
            terms.append(f"{w} * coalesce({'max' if how == 'max' else 'avg'}(iss.severity) FILTER (iss.type = '{key}'), 0)")
    if len(parts) == 1:
        sure = f"arg_max(iss.confidence, iss.severity) FILTER (iss.type = '{types[0]}')"
    else:
        sure = f"min(iss.confidence) FILTER (iss.type IN {_in(types)})"
    total = sum(w for w, _, _ in parts)
    return f"SELECT sc.doc_id, '{kind}' AS type, ({' + '.join(terms)}) / {total} AS severity, coalesce({sure}, 0) AS confidence, {order} AS rule_order FROM sc LEFT JOIN iss USING (doc_id) GROUP BY sc.doc_id HAVING severity > {threshold}"


_DIAGNOSES = _ISSUES + f", sc AS (SELECT {_SCORES} FROM f), dia AS (" + " UNION ALL ".join(_diagnosis(i, *d) for i, d in enumerate(C.DIAGNOSES)) + ")"
_MAPPED = "(VALUES " + ", ".join(f"('{d}', '{k}', '{','.join(f.split())}')" for d, (k, f) in C.INTERVENTIONS.items()) + ") AS im(type, intervention, focus_features)"

_DOCUMENT_EVIDENCE = " UNION ALL ".join(f"SELECT doc_id, {C.EMISSION[kind]} AS emission, 0 AS place, '{x}' AS name, {x} AS value FROM f WHERE {x} IS NOT NULL" for kind, _, parts in C.ISSUES for x, _, _ in parts)
_EVIDENCE = f"""ev AS ({_DOCUMENT_EVIDENCE}
 UNION ALL SELECT doc_id, {C.EMISSION['sentence_complexity']}, sent_idx, 'token_count', n::DOUBLE FROM sd UNION ALL SELECT doc_id, {C.EMISSION['sentence_complexity']}, sent_idx, 'tree_depth', greatest(depth - 1, 0)::DOUBLE FROM sd
 UNION ALL SELECT doc_id, {C.EMISSION['weak_cohesion']}, sent_idx, 'jaccard', ({_ALIKE})::DOUBLE FROM sd WHERE before IS NOT NULL)"""
_STEPS = "(VALUES " + ", ".join(f"('{d}', '{';'.join(C.ACTIONS[d])}', '{';'.join(C.EXERCISES[d])}')" for d in C.INTERVENTIONS) + ") AS sp(type, actions, exercises)"


def _support(kind: str, parts) -> tuple[str, str]:
    """SQL of the supporting issues of a diagnosis, and of its evidence."""
    keys = [key for _, how, key in parts if how != "score"]
    joins = " ".join(f"LEFT JOIN ia a{i} ON a{i}.doc_id = d.doc_id AND a{i}.itype = '{k}'" for i, k in enumerate(keys))
    names = ", ".join(f"CASE WHEN a{i}.n > 0 THEN '{k}' END" for i, k in enumerate(keys))
    count = " + ".join(f"coalesce(a{i}.n, 0)" for i in range(len(keys)))
    support = f"SELECT d.doc_id, d.type, array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS issues, {count} AS spans FROM dia d {joins} WHERE d.type = '{kind}'"
    evidence = []
    for _, how, key in parts:
        if how == "score":
            evidence.append(f"SELECT d.doc_id, d.type, '{key}_score' AS name, coalesce(sc.{key}, 0)::DOUBLE AS value FROM dia d JOIN sc USING (doc_id) WHERE d.type = '{kind}'")
            evidence.append(f"SELECT d.doc_id, d.type, '{key}_missing', 1.0::DOUBLE FROM dia d JOIN sc USING (doc_id) WHERE d.type = '{kind}' AND sc.{key} IS NULL")
        else:
            evidence.append(f"SELECT d.doc_id, d.type, '{how}_{key}_severity' AS name, coalesce(a.{'mx' if how == 'max' else 'av'}, 0)::DOUBLE AS value FROM dia d LEFT JOIN ia a ON a.doc_id = d.doc_id AND a.itype = '{key}' WHERE d.type = '{kind}'")
    return support, " UNION ALL ".join(evidence)


_SUPPORT = "ia AS (SELECT doc_id, type AS itype, max(severity) AS mx, avg(severity) AS av, count(*) AS n FROM iss GROUP BY ALL), su AS (" + " UNION ALL ".join(_support(k, p)[0] for k, _, p in C.DIAGNOSES) + "), de AS (" + " UNION ALL ".join(_support(k, p)[1] for k, _, p in C.DIAGNOSES) + ")"


def _mean_of_present(parts: list[tuple[float, str]]) -> str:
    """Weighted mean of the parts that are not null, within 0 and 1."""
    total = " + ".join(f"coalesce({w} * ({x}), 0)" for w, x in parts)
    weight = " + ".join(f"CASE WHEN ({x}) IS NOT NULL THEN {w} ELSE 0 END" for w, x in parts)
    mean = f"({total}) / nullif({weight}, 0)"
    return f"CASE WHEN ({mean}) IS NOT NULL THEN greatest(0, least(1, {mean})) END"


def _scaled(f: str) -> str:
    """A feature scaled to its range; null stays null."""
    return f"CASE WHEN {f} IS NOT NULL THEN {_normalized(f)} END"


_STYLE = {f: "CASE WHEN sentence_length_trend IS NOT NULL THEN " + _norm("abs(sentence_length_trend)", 0.0, C.RANGES[f][1]) + " END" if f == "sentence_length_trend" else _scaled(f) for f in C.STYLE_WEIGHTS}
_PARTIAL_SCORES = {
    "difficulty": _mean_of_present([(w, _scaled(f)) for f, w in C.DIFFICULTY_WEIGHTS.items()]),
    "style": " + ".join(f"coalesce({w} * {_STYLE[f]}, 0)" for f, w in C.STYLE_WEIGHTS.items()),
    "fluency": _mean_of_present([(1.0, "punctuation_ratio"), (1.0, f"1 - {_scaled('sentence_length_variance')}"), (1.0, f"1 - {_scaled('pos_distribution_variance')}")]),
    "cohesion": _mean_of_present([(0.4, _scaled("connective_ratio")), (0.3, _scaled("sentence_overlap")), (0.3, f"1 - {_scaled('pronoun_to_noun_ratio')}")]),
    "complexity": _mean_of_present([(1.0, x) for x in ("binyan_entropy", _scaled("agreement_error_rate"), _scaled("pos_distribution_variance"), _scaled("clause_type_entropy"), "construct_ratio * 0.5")]),
}

_FLAT = "(SELECT doc_id, feature, value FROM flat_features)"
_RANKED = "rk AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY feature) AS g FROM flat_features WHERE value IS NOT NULL AND NOT isnan(value))"
_SUMMARY = (
    _RANKED
    + """, su AS (SELECT feature, count(*) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean, median(value) AS median, coalesce(stddev_samp(value), 0) AS stdev,
 max(CASE WHEN r = CASE WHEN g >= 4 THEN g // 4 ELSE 0 END THEN value END) AS q1, max(CASE WHEN r = CASE WHEN g >= 4 THEN 3 * g // 4 ELSE g - 1 END THEN value END) AS q3 FROM rk GROUP BY 1)"""
)
_RANGES = "(VALUES " + ", ".join(f"('{f}', {lo}::DOUBLE, {hi}::DOUBLE)" for f, (lo, hi) in C.RANGES.items()) + ") AS rg(feature, low, high)"
_WIDE = "w AS (SELECT doc_id, " + ", ".join(f"max(value) FILTER (feature = '{f}' AND NOT isnan(value)) AS {f}" for f in C.FEATURES) + " FROM flat_features GROUP BY 1)"


def _pearson(a: str, b: str) -> str:
    both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"CASE WHEN count(*) {both} >= 3 AND stddev_pop({a}) {both} > 1e-12 AND stddev_pop({b}) {both} > 1e-12 THEN corr({a}, {b}) {both} END"


_FINITE = "fsc AS (SELECT record_id, scored_at, loaded_at, " + ", ".join(f"CASE WHEN NOT isnan({k}) THEN {k} END AS {k}" for k in C.SCORE_KEYS) + " FROM scores)"
_LABELS = [(kind, k) for kind, keys in (("scores", C.SCORE_KEYS), ("issues", C.ISSUE_KEYS), ("diagnoses", C.DIAGNOSIS_KEYS)) for k in keys]
_LONG = "lg AS (" + " UNION ALL ".join(f"SELECT record_id, '{kind}' AS kind, '{k}' AS key, coalesce({kind}['{k}'], 0.0) AS label, (record_id * {i + 3} % 97) / 97.0::DOUBLE AS predicted FROM training_records" for i, (kind, k) in enumerate(_LABELS)) + ")"
_CLIP = "greatest(1e-7, least(1 - 1e-7, predicted))"
_ENTROPY = f"-(least(1, greatest(0, label)) * ln({_CLIP}) + (1 - least(1, greatest(0, label))) * ln(1 - {_CLIP}))"
_RECORD_SENTENCES = f"rs0 AS (SELECT record_id, text, sentence_complexities, cohesion_pairs, issues, {_SPLIT} AS l FROM training_records WHERE text IS NOT NULL)"
_OFFSETS = (
    f"rs1 AS (SELECT record_id, text, sentence_complexities, cohesion_pairs, list_filter(string_split(regexp_replace(text, '([.!?])({SPACE}+)', '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(1)), lambda x: true) AS raw FROM training_records WHERE text IS NOT NULL),"
    "rs2 AS (SELECT record_id, sentence_complexities, cohesion_pairs, unnest(raw) AS piece, generate_subscripts(raw, 1) AS k FROM rs1),"
    "rs3 AS (SELECT *, CASE WHEN k > 1 THEN length(split_part(piece, chr(2), 1)) ELSE 0 END AS gap, CASE WHEN k > 1 THEN substr(piece, length(split_part(piece, chr(2), 1)) + 2) ELSE piece END AS sent FROM rs2),"
    "rs4 AS (SELECT *, sum(gap + length(sent)) OVER (PARTITION BY record_id ORDER BY k) AS stop FROM rs3),"
    "rs AS (SELECT record_id, sent, stop - length(sent) AS char_start, stop AS char_end, row_number() OVER (PARTITION BY record_id ORDER BY k) - 1 AS idx, sentence_complexities, cohesion_pairs FROM rs4 WHERE sent <> '')"
)
_HIGHLIGHT = "CASE WHEN {0} > 0.7 THEN 'red' WHEN {0} >= 0.4 THEN 'yellow' ELSE 'none' END"
_BAND = "CASE WHEN {0} > 0.7 THEN 'high' WHEN {0} > 0.4 THEN 'medium' ELSE 'low' END"
_GATE = f"""SELECT doc_id, CASE WHEN length(regexp_replace(t, {_STRIP}, '', 'g')) < 200 THEN 'too_short' WHEN length(regexp_replace(t, {_STRIP}, '', 'g')) > 50000 THEN 'too_long' WHEN marks < 3 THEN 'few_sentences'
 WHEN hebrew < 0.5 THEN 'low_hebrew' WHEN repetition > 0.3 THEN 'repetitive' WHEN links > 0.2 THEN 'url_heavy' ELSE 'passed' END AS reason FROM ra"""
_RATIOS = f"""ra0 AS (SELECT doc_id, text, coalesce(text, '') AS t, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]'), lambda x: regexp_replace(x, {_STRIP}, '', 'g')), lambda x: x <> '') AS parts, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
ra AS (SELECT doc_id, text, t, len(regexp_extract_all(t, '[.!?]')) AS marks, coalesce(len(regexp_extract_all(t, '[֐-׿]')) / nullif(length(regexp_replace(t, '{SPACE}', '', 'g')), 0), 0.0) AS hebrew,
 CASE WHEN len(parts) >= 2 THEN (len(parts) - len(list_distinct(parts))) / len(parts) ELSE 0.0 END AS repetition, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: regexp_matches(x, '{LINK}'))) / len(ws) ELSE 0.0 END AS links FROM ra0)"""


def oracle_sql() -> dict[str, str]:
    out = {f"{g}_features": f"WITH {_FEATURES} SELECT doc_id, {_round(' '.join(n for n in names if n != 'rare_word_ratio'))} FROM f" for g, names in C.FEATURE_GROUPS.items()}
    out["token_counts"] = f"SELECT doc_id, len({_SPLIT}) AS n_sentences, len(regexp_extract_all(text, '{TOKEN}')) AS n_tokens, len(regexp_extract_all(text, '{WORD}')) AS n_words FROM documents WHERE text IS NOT NULL"
    out["token_affixes"] = f"SELECT {_prefix('t')} AS prefix, {_suffix('t')} AS suffix, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS t FROM documents) GROUP BY ALL"
    out["binyan_distribution"] = f"WITH {_TOKENS} SELECT doc_id, binyan, count(*) AS n FROM tb WHERE binyan IS NOT NULL GROUP BY ALL"
    out["freq_dict"] = f"SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS token FROM training_records) GROUP BY 1"
    out["rare_word_ratio"] = f"""WITH {_TOKENS}, fd AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS token FROM training_records) GROUP BY 1),
 rw AS (SELECT doc_id, avg((coalesce(cnt, 0) < {C.RARE_COUNT})::INT) AS r FROM tb LEFT JOIN fd ON fd.token = tb.lemma GROUP BY 1) SELECT d.doc_id, round(coalesce(r, 0) + 2e-9, 6)::DOUBLE AS rare_word_ratio FROM documents d LEFT JOIN rw USING (doc_id)"""
    out["feature_stats"] = f"WITH {_DOC_STATS} {_STAT_SELECT}"
    out["feature_stats_flat"] = f"WITH {_stats('flat_features')} {_STAT_SELECT}"
    merged = "(SELECT feature, value FROM flat_features UNION ALL SELECT unnest(map_keys(raw_features)), unnest(map_values(raw_features)) FROM analysis_inputs)"
    out["feature_stats_merged"] = f"WITH {_stats(merged)} {_STAT_SELECT}"
    out["composite_scores"] = f"WITH {_FEATURES}, sc AS (SELECT {_SCORES} FROM f) SELECT doc_id, {_round(' '.join(C.SCORE_KEYS))} FROM sc"
    out["normalized_features"] = f"WITH {_FEATURES} SELECT doc_id, " + ", ".join(f"round({_normalized(f)} + 2e-9, 6) + 0.0 AS {f}" for f in [*C.RANGES, *C.PASS_THROUGH] if f != "rare_word_ratio") + " FROM f"
    out["issue_table"] = f"WITH {_ISSUES} SELECT doc_id, emit_order, type, issue_group, round(severity + 2e-9, 6)::DOUBLE AS severity, round(least(1, confidence) + 2e-9, 6)::DOUBLE AS confidence, span FROM iss"
    out["group_scores"] = f"WITH {_ISSUES} SELECT doc_id, issue_group, round(avg(severity) + 2e-9, 6)::DOUBLE AS group_score, count(*) AS issues FROM iss GROUP BY ALL"
    out["ranked_issues_topk"] = f"""WITH {_ISSUES}, rr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(0.7 * severity + 0.3 * group_score, 9) DESC, emit_order) AS rank FROM iss)
 SELECT doc_id, rank, type, issue_group, round(severity + 2e-9, 6)::DOUBLE AS severity, round(least(1, confidence) + 2e-9, 6)::DOUBLE AS confidence, span, round(round(0.7 * severity + 0.3 * group_score, 9) + 2e-9, 6)::DOUBLE AS rank_score, round(group_score + 2e-9, 6)::DOUBLE AS group_score FROM rr WHERE rank <= 5"""
    out["issue_vector"] = f"WITH {_ISSUES} SELECT doc_id, " + ", ".join(f"round(coalesce(max(severity) FILTER (type = '{k}'), 0) + 2e-9, 6)::DOUBLE AS {k}" for k in C.ISSUE_KEYS) + " FROM iss GROUP BY 1"
    out["diagnosis_table"] = f"WITH {_DIAGNOSES} SELECT doc_id, type, {_round('severity confidence')} FROM dia"
    out["intervention_table"] = f"WITH {_DIAGNOSES} SELECT doc_id, type AS diagnosis, intervention, round(severity + 2e-9, 6) + 0.0 AS priority, focus_features FROM dia JOIN {_MAPPED} USING (type)"
    out["analyze_view"] = f"""WITH {_DIAGNOSES}, sh AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(severity, 9) DESC, rule_order) AS place FROM dia WHERE severity > 0.45)
 SELECT doc_id, type AS diagnosis, intervention, round(severity + 2e-9, 6) + 0.0 AS priority, place, {_BAND.format('severity')} AS band FROM sh JOIN {_MAPPED} USING (type) WHERE place <= 3"""
    out["issue_evidence"] = f"WITH {_ISSUES}, {_EVIDENCE} SELECT iss.doc_id, emit_order, type, name, round(value + 2e-9, 6)::DOUBLE AS value FROM iss JOIN ev ON ev.doc_id = iss.doc_id AND ev.emission = iss.emission AND ev.place = iss.place"
    out["issue_sentences"] = f"""WITH {_ISSUES}, rr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(0.7 * severity + 0.3 * group_score, 9) DESC, emit_order) AS rank FROM iss)
 SELECT rr.doc_id, rank, md5(CASE WHEN type = 'weak_cohesion' THEN a.sent || ' / ' || b.sent ELSE b.sent END) AS digest FROM rr LEFT JOIN sk a ON a.doc_id = rr.doc_id AND a.sent_idx = rr.place - 1 JOIN sk b ON b.doc_id = rr.doc_id AND b.sent_idx = rr.place
 WHERE rank <= 5 AND (type IN ('weak_cohesion', 'sentence_complexity') OR span = '0-1')"""
    out["diagnosis_support"] = f"""WITH {_DIAGNOSES}, {_SUPPORT} SELECT su.doc_id, su.type, issues, spans, actions || ';' || exercises AS steps, name, round(value + 2e-9, 6)::DOUBLE AS value FROM su JOIN de ON de.doc_id = su.doc_id AND de.type = su.type JOIN {_STEPS} ON sp.type = su.type"""
    out["diagnosis_vector"] = f"WITH {_DIAGNOSES} SELECT doc_id, " + ", ".join(f"round(coalesce(max(severity) FILTER (type = '{k}'), 0) + 2e-9, 6)::DOUBLE AS {k}" for k in C.DIAGNOSIS_KEYS) + " FROM dia GROUP BY 1"
    out["derived_interventions"] = f"""WITH dm AS (SELECT record_id, unnest(map_keys(diagnoses)) AS type, unnest(map_values(diagnoses)) AS severity FROM training_records)
 SELECT record_id, type AS diagnosis, intervention, round(severity + 2e-9, 6)::DOUBLE AS priority, actions FROM dm JOIN {_MAPPED} USING (type) JOIN {_STEPS} USING (type) WHERE severity > 0.5"""
    largest = ", ".join([*(f"round(coalesce(any_value(sc.{k}), 0) + 2e-9, 6)::DOUBLE AS scores_{k}" for k in C.SCORE_KEYS), *(f"round(coalesce(max(iss.severity) FILTER (iss.type = '{k}'), 0) + 2e-9, 6)::DOUBLE AS issues_{k}" for k in C.ISSUE_KEYS)])
    given = ", ".join(f"round(coalesce(max(severity) FILTER (type = '{k}'), 0) + 2e-9, 6)::DOUBLE AS diagnoses_{k}" for k in C.DIAGNOSIS_KEYS)
    missing = ", ".join(f"coalesce(diagnoses_{k}, 0) AS diagnoses_{k}" for k in C.DIAGNOSIS_KEYS)
    out["training_export"] = f"""WITH {_DIAGNOSES}, le AS (SELECT sc.doc_id, {largest}, round(coalesce(sum(iss.severity) FILTER (iss.type = 'sentence_complexity'), 0) + 2e-9, 6)::DOUBLE AS complexity, round(coalesce(sum(iss.severity) FILTER (iss.type = 'weak_cohesion'), 0) + 2e-9, 6)::DOUBLE AS cohesion FROM sc LEFT JOIN iss USING (doc_id) GROUP BY 1),
 dv AS (SELECT doc_id, {given} FROM dia GROUP BY 1) SELECT le.*, {missing} FROM le LEFT JOIN dv USING (doc_id)"""
    hidden = {f: "m" for f in C.FEATURE_GROUPS["morphology"]} | {f: "s" for f in C.FEATURE_GROUPS["syntax"]}
    layered = ", ".join(f"CASE WHEN doc_id % {3 if hidden[f] == 'm' else 5} <> 0 THEN {f} END AS {f}" if f in hidden else f for f in C.FEATURES)
    out["missing_layers"] = f"WITH {_FEATURES}, fl AS (SELECT doc_id, {layered} FROM f) SELECT doc_id, {_round('verb_ratio binyan_entropy avg_sentence_length clause_type_entropy type_token_ratio')}, " + ", ".join(f"round({x} + 2e-9, 6)::DOUBLE AS {k}" for k, x in _PARTIAL_SCORES.items()) + " FROM fl"
    out["synthetic_metrics"] = f"""WITH {_RECORD_SENTENCES}, ms AS (SELECT record_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS place FROM rs0)
 SELECT record_id, place, len(regexp_extract_all(s, '{WORD}')) AS n, len(list_distinct(regexp_extract_all(s, '{WORD}'))) AS kinds, 5.0::DOUBLE AS depth FROM ms"""
    out["text_ratios"] = f"WITH {_RATIOS} SELECT doc_id, marks, {_round('hebrew repetition links')} FROM ra WHERE text IS NOT NULL"
    out["quality_gate"] = f"WITH {_RATIOS} {_GATE}"
    out["rejection_histogram"] = f"WITH {_RATIOS} SELECT reason, count(*) AS n FROM ({_GATE}) GROUP BY 1"
    out["fixed_size_groups"] = f"""WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
 l1 AS (SELECT doc_id, k, regexp_replace(line, {_STRIP}, '', 'g') AS line FROM l0), l2 AS (SELECT *, row_number() OVER (ORDER BY doc_id, k) - 1 AS r FROM l1 WHERE line <> '')
 SELECT printf('doc_%07d', r // 20 + 1) AS doc, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY r)) AS digest FROM l2 GROUP BY r // 20"""
    out["summary_stats"] = f"WITH {_SUMMARY} SELECT feature, n, {_round('min max mean median stdev q1 q3')}, round(q3 - q1 + 2e-9, 6) + 0.0 AS iqr, round(q1 - 1.5 * (q3 - q1) + 2e-9, 6) + 0.0 AS lower, round(q3 + 1.5 * (q3 - q1) + 2e-9, 6) + 0.0 AS upper FROM su"
    out["iqr_outliers"] = f"""WITH {_SUMMARY} SELECT doc_id, feature, round(value + 2e-9, 6) + 0.0 AS value, CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN 'LOW' ELSE 'HIGH' END AS side FROM flat_features JOIN su USING (feature)
 WHERE value IS NOT NULL AND NOT isnan(value) AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))"""
    out["range_fitness"] = f"""WITH {_SUMMARY}, rf AS (SELECT feature, any_value(low) AS low, any_value(high) AS high, count(*) FILTER (value < low) AS below, count(*) FILTER (value > high) AS above, count(*) AS n FROM rk JOIN {_RANGES} USING (feature) GROUP BY 1)
 SELECT feature, below, rf.n - below - above AS inside, above, round(100.0::DOUBLE * below / rf.n + 2e-9, 6) AS pct_below, round(100.0::DOUBLE * above / rf.n + 2e-9, 6) AS pct_above,
 CASE WHEN 100.0 * below / rf.n > 20 OR 100.0 * above / rf.n > 20 THEN 'widen' WHEN below + above = 0 AND max - min < 0.3 * (high - low) THEN 'tighten' ELSE 'fits' END AS verdict,
 CASE WHEN 100.0 * below / rf.n > 20 OR 100.0 * above / rf.n > 20 THEN round(greatest(0, q1 - 0.5 * (q3 - q1)) + 2e-9, 6) + 0.0 END AS suggested_low, CASE WHEN 100.0 * below / rf.n > 20 OR 100.0 * above / rf.n > 20 THEN round(q3 + 0.5 * (q3 - q1) + 2e-9, 6) + 0.0 END AS suggested_high FROM rf JOIN su USING (feature)"""
    out["null_counts"] = "SELECT feature, count(*) FILTER (value IS NULL) AS nulls, count(*) AS n FROM flat_features GROUP BY 1"
    out["layer_health"] = f"""WITH {_WIDE} SELECT count(*) AS total, count(verb_ratio) AS morphology_ok, count(avg_sentence_length) AS syntax_ok, count(*) FILTER (verb_ratio IS NOT NULL AND avg_sentence_length IS NOT NULL) AS both_ok,
 round(100.0::DOUBLE * count(*) FILTER (verb_ratio IS NOT NULL AND avg_sentence_length IS NOT NULL) / count(*) + 2e-9, 6) AS pct, min(doc_id) FILTER (verb_ratio IS NULL OR avg_sentence_length IS NULL) AS first_failing FROM w"""
    targets = ["avg_sentence_length", "type_token_ratio"]
    cells = " UNION ALL ".join(f"SELECT '{a}' AS score, '{b}' AS feature, {_pearson(a, b)} AS r FROM w" for a in targets for b in C.FEATURES if b not in targets)
    out["feature_correlations"] = f"WITH {_WIDE}, cc AS ({cells}), pl AS (SELECT *, row_number() OVER (PARTITION BY score ORDER BY round(abs(r), 9) DESC, feature) AS place FROM cc WHERE abs(r) > 0.05) SELECT score, feature, round(r + 2e-9, 6) + 0.0 AS r, place FROM pl WHERE place <= 8"
    keys = sorted(C.SCORE_KEYS)
    cells = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_pearson(a, b)} AS r FROM fsc" for i, a in enumerate(keys) for b in keys[i + 1 :])
    out["score_correlations"] = f"WITH {_FINITE}, cc AS ({cells}) SELECT a, b, round(r + 2e-9, 6) + 0.0 AS r, abs(r) > 0.7 AS redundant FROM cc"
    out["score_histogram"] = "SELECT greatest(0, least(9, floor(greatest(least(difficulty, 1e6), -1e6) * 10)))::INT AS bucket, count(*) AS n FROM scores WHERE difficulty IS NOT NULL AND NOT isnan(difficulty) GROUP BY 1"
    w = "OVER (PARTITION BY record_id ORDER BY scored_at NULLS FIRST, loaded_at NULLS FIRST, " + ", ".join(f"{k} NULLS FIRST" for k in C.SCORE_KEYS) + ")"
    deltas = ", ".join(f"{k} - lag({k}) {w} AS d_{k}" for k in C.SCORE_KEYS)
    moved = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN abs(d_{k}) > 0.005 THEN '{k}' END" for k in C.SCORE_KEYS) + "], lambda x: x IS NOT NULL), ',')"
    out["revision_deltas"] = f"WITH {_FINITE}, dd AS (SELECT record_id, row_number() {w} AS revision, {deltas} FROM (SELECT DISTINCT * FROM fsc)) SELECT record_id, revision, {_round(' '.join('d_' + k for k in C.SCORE_KEYS))}, {moved} AS moved FROM dd WHERE revision > 1"
    out["severity_bands"] = f"WITH {_FINITE} SELECT {_BAND.format('difficulty')} AS band, {_HIGHLIGHT.format('difficulty')} AS highlight, count(*) AS n FROM fsc WHERE difficulty IS NOT NULL GROUP BY ALL"
    out["label_stats"] = f"WITH {_LONG} SELECT kind, key, round(avg(label) + 2e-9, 6) + 0.0 AS mean, round(stddev_pop(label) + 2e-9, 6) + 0.0 AS std, round(avg((label > 0)::INT) + 2e-9, 6) + 0.0 AS active FROM lg GROUP BY ALL"
    out["export_records"] = f"""WITH {_ISSUES}, ex AS (SELECT d.doc_id, coalesce(max(c.n), 0) AS n, coalesce(sum(severity) FILTER (type = 'sentence_complexity'), 0) AS complexity, coalesce(sum(severity) FILTER (type = 'weak_cohesion'), 0) AS cohesion FROM documents d LEFT JOIN nsent c USING (doc_id) LEFT JOIN iss USING (doc_id) GROUP BY 1)
 SELECT doc_id, n AS sentences, round(complexity + 2e-9, 6)::DOUBLE AS complexity, greatest(n - 1, 0) AS pairs, round(cohesion + 2e-9, 6)::DOUBLE AS cohesion FROM ex"""
    total = lambda name, size: f"coalesce(list_sum(list_transform(list_slice(coalesce({name}, []), 1, {size}), lambda x: least(1, greatest(0, coalesce(x, 0))))), 0)"
    out["trained_labels"] = f"WITH {_RECORD_SENTENCES} SELECT record_id, len(l) AS sentences, round({total('sentence_complexities', 'len(l)')} + 2e-9, 6)::DOUBLE AS complexity, greatest(len(l) - 1, 0) AS pairs, round({total('cohesion_pairs', 'greatest(len(l) - 1, 0)')} + 2e-9, 6)::DOUBLE AS cohesion, round({total('map_values(issues)', '1000')} + 2e-9, 6)::DOUBLE AS issue_sum FROM rs0"
    hit, miss, gone = "predicted >= 0.5 AND label >= 0.5", "predicted >= 0.5 AND label < 0.5", "predicted < 0.5 AND label >= 0.5"
    out["f1_per_type"] = f"WITH {_LONG}, c AS (SELECT kind, key, count(*) FILTER ({hit}) AS tp, count(*) FILTER ({miss}) AS fp, count(*) FILTER ({gone}) AS fn FROM lg WHERE kind <> 'scores' GROUP BY ALL) SELECT kind, key, tp, fp, fn, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) + 2e-9, 6)::DOUBLE AS f1 FROM c"
    out["rmse_scores"] = f"WITH {_LONG} SELECT kind, key, round(sqrt(avg((predicted - label) ** 2)) + 2e-9, 6) AS rmse FROM lg WHERE kind = 'scores' GROUP BY ALL"
    out["spearman"] = f"""WITH {_LONG}, r AS (SELECT kind, key, row_number() OVER (PARTITION BY kind, key ORDER BY predicted, record_id) AS a, row_number() OVER (PARTITION BY kind, key ORDER BY label, record_id) AS b FROM lg WHERE kind <> 'scores')
 SELECT kind, key, round(CASE WHEN count(*) >= 2 THEN 1 - 6 * sum((a - b) ** 2)::DOUBLE / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)) ELSE 0 END + 2e-9, 6)::DOUBLE AS rho FROM r GROUP BY ALL"""
    out["multitask_loss"] = f"""WITH {_LONG}, m AS (SELECT avg((predicted - label) ** 2) FILTER (kind = 'scores') AS scores, avg({_ENTROPY}) FILTER (kind = 'issues') AS issues, avg({_ENTROPY}) FILTER (kind = 'diagnoses') AS diagnoses FROM lg)
 SELECT {_round('scores issues diagnoses')}, round(scores + 1.5 * issues + 2.0 * diagnoses + 2e-9, 6) + 0.0 AS total FROM m"""
    out["disagreements"] = f"WITH {_LONG} SELECT kind, key, count(*) FILTER (abs(predicted - label) > 0.3) AS differing, count(*) AS n FROM lg GROUP BY ALL"
    out["disagreement_cases"] = f"WITH {_LONG} SELECT record_id, count(*) FILTER (abs(predicted - label) > 0.3) AS keys, round(max(label) FILTER (kind = 'scores' AND key = 'difficulty') + 2e-9, 6)::DOUBLE AS difficulty FROM lg GROUP BY 1 HAVING keys > 0"
    out["evaluation"] = " UNION ALL ".join(f"SELECT '{m}' AS metric, kind, key, {c} AS value FROM ({out[q]})" for m, q, c in (("rmse", "rmse_scores", "rmse"), ("f1", "f1_per_type", "f1"), ("spearman", "spearman", "rho")))
    top = lambda name, key: f"round(CASE WHEN len({name}) > 0 THEN list_max({name}) ELSE issues['{key}'] END + 2e-9, 6)::DOUBLE"
    out["named_predictions"] = f"""SELECT record_id, len(list_filter(sentence_complexities, lambda x: x > 0.3)) AS sentences, len(list_filter(cohesion_pairs, lambda x: x > 0.3)) AS pairs, {top('sentence_complexities', 'sentence_complexity')} AS complexity, {top('cohesion_pairs', 'weak_cohesion')} AS cohesion
 FROM training_records WHERE issues IS NOT NULL AND sentence_complexities IS NOT NULL AND cohesion_pairs IS NOT NULL"""
    out["skip_take"] = "SELECT doc_id, printf('doc_%07d', r - 100) AS name FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r > 100 AND r <= 300"
    out["mapped_punctuation"] = """SELECT doc_id, md5(replace(translate(text, '“”‘’—–' || chr(160), '""' || chr(39) || chr(39) || '-- '), '…', '...')) AS digest, md5(trim(regexp_replace(replace(text, chr(9), ' '), ' +', ' ', 'g'), ' ')) AS parser_digest FROM documents"""
    out["merge_last_wins"] = """WITH b AS (SELECT coalesce(text, '') AS text, record_id, (split <> 'train')::INT AS newer FROM training_records WHERE split IS NOT NULL)
 SELECT md5(text) AS digest, arg_max(record_id, newer * 1000000000000 + record_id) AS record_id, min(newer) = 1 AS added FROM b GROUP BY text"""
    sure = "(" + " + ".join(f"coalesce(diagnoses['{k}'], 0)" for k in C.DIAGNOSIS_KEYS) + f") / {len(C.DIAGNOSIS_KEYS)}"
    out["hybrid_routing"] = f"SELECT record_id, round({sure} + 2e-9, 6)::DOUBLE AS confidence, CASE WHEN {sure} > 0.2 THEN 'model' ELSE 'pipeline' END AS origin, round(coalesce(diagnoses['low_cohesion'], 0) * CASE WHEN {sure} > 0.2 THEN 1 ELSE 0.5 END + 2e-9, 6)::DOUBLE AS low_cohesion FROM training_records"
    out["train_val_split"] = "SELECT record_id, CASE WHEN row_number() OVER (ORDER BY md5(record_id::VARCHAR || '|42'), record_id) <= greatest(1, floor(count(*) OVER () * 0.1)) THEN 'val' ELSE 'train' END AS part FROM training_records"
    pairs = "(SELECT 'sentence_cosine_similarity' AS feature, list_dot_product(embedding::DOUBLE[], prev::DOUBLE[]) AS value FROM (SELECT embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings) WHERE prev IS NOT NULL)"
    out["embedding_cohesion"] = f"WITH {_stats(pairs)} SELECT feature, {_round(_STAT_COLUMNS, 5)}, valid_count, unstable, degenerate FROM st"
    complexity = "CASE WHEN coalesce(sentence_complexities[idx + 1], 0) > 0.3 THEN sentence_complexities[idx + 1] ELSE 0.0 END"
    out["sentence_annotations"] = f"WITH {_OFFSETS} SELECT record_id, idx AS index, md5(sent) AS digest, char_start::BIGINT AS char_start, char_end::BIGINT AS char_end, round({complexity} + 2e-9, 6) + 0.0 AS complexity, {_HIGHLIGHT.format('(' + complexity + ')')} AS highlight FROM rs"
    out["cohesion_gaps"] = f"""WITH {_OFFSETS}, g AS (SELECT record_id, idx, cohesion_pairs[idx + 1] AS severity, char_end AS char_start, lead(char_start) OVER (PARTITION BY record_id ORDER BY idx) AS char_end FROM rs)
 SELECT record_id, idx AS index, round(severity + 2e-9, 6) + 0.0 AS severity, char_start::BIGINT AS char_start, char_end::BIGINT AS char_end FROM g WHERE severity >= 0.45 AND char_end IS NOT NULL"""
    out["resumable_antijoin"] = "SELECT record_id, source FROM training_records WHERE record_id NOT IN (SELECT record_id FROM analysis_inputs WHERE record_id IS NOT NULL)"
    cut = "left(text, 120)"
    last = f"length({cut}) - length(regexp_extract({cut}, '[^.!?]*$'))"
    out["share_url"] = f"SELECT id, md5(url_encode(base64(encode(text)))) AS digest, true AS same, CASE WHEN length(text) <= 120 THEN text WHEN {last} > 0.4 * 120 THEN left({cut}, {last}) || ' …' ELSE {cut} || '…' END AS short FROM example_texts"
    return out
