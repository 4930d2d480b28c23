"""Fixed values that results must agree on: names, weights, ranges, word lists and tables."""

# Features by group, in order.
FEATURE_GROUPS = {
    "morphology": "verb_ratio prefix_density suffix_pronoun_ratio morphological_ambiguity agreement_error_rate binyan_entropy construct_ratio".split(),
    "syntax": "avg_sentence_length avg_tree_depth max_tree_depth avg_dependency_distance clauses_per_sentence subordinate_clause_ratio right_branching_ratio dependency_distance_variance clause_type_entropy".split(),
    "lexicon": "type_token_ratio hapax_ratio avg_token_length lemma_diversity rare_word_ratio content_word_ratio".split(),
    "structure": "sentence_length_variance long_sentence_ratio punctuation_ratio short_sentence_ratio missing_terminal_punctuation_ratio".split(),
    "discourse": "connective_ratio sentence_overlap pronoun_to_noun_ratio".split(),
    "style": "sentence_length_trend pos_distribution_variance".split(),
}
FEATURES = [name for group in FEATURE_GROUPS.values() for name in group]

SCORE_KEYS = "difficulty style fluency cohesion complexity".split()
ISSUE_KEYS = (
    "agreement_errors morphological_ambiguity low_morphological_diversity sentence_complexity dependency_spread excessive_branching "
    "low_lexical_diversity rare_word_overuse low_content_density sentence_length_variability punctuation_issues fragmentation "
    "weak_cohesion missing_connectives pronoun_ambiguity structural_inconsistency sentence_progression_drift"
).split()
DIAGNOSIS_KEYS = (
    "low_lexical_diversity pronoun_overuse low_cohesion sentence_over_complexity structural_inconsistency "
    "low_morphological_richness fragmented_writing punctuation_deficiency"
).split()

# Weights and ranges of the scores.
DIFFICULTY_WEIGHTS = {"avg_sentence_length": 0.30, "avg_tree_depth": 0.25, "hapax_ratio": 0.25, "morphological_ambiguity": 0.20}
STYLE_WEIGHTS = {"suffix_pronoun_ratio": 0.25, "hapax_ratio": -0.25, "sentence_length_trend": 0.20, "pos_distribution_variance": -0.15, "pronoun_to_noun_ratio": 0.15}
RANGES = {
    "avg_sentence_length": (10.0, 40.0),
    "avg_tree_depth": (4.0, 15.0),
    "hapax_ratio": (0.15, 0.55),
    "morphological_ambiguity": (4.0, 10.0),
    "suffix_pronoun_ratio": (0.05, 0.50),
    "sentence_length_variance": (0.0, 400.0),
    "sentence_length_trend": (-1.5, 1.5),
    "pos_distribution_variance": (0.0, 0.008),
    "pronoun_to_noun_ratio": (0.0, 0.45),
    "rare_word_ratio": (0.0, 0.3),
    "content_word_ratio": (0.1, 0.8),
    "connective_ratio": (0.0, 1.2),
    "sentence_overlap": (0.0, 0.4),
    "agreement_error_rate": (0.0, 0.3),
    "dependency_distance_variance": (0.0, 27.0),
    "clause_type_entropy": (2.0, 3.0),
}
PASS_THROUGH = (
    "verb_ratio prefix_density binyan_entropy construct_ratio avg_dependency_distance clauses_per_sentence subordinate_clause_ratio right_branching_ratio "
    "type_token_ratio avg_token_length lemma_diversity long_sentence_ratio punctuation_ratio short_sentence_ratio missing_terminal_punctuation_ratio"
).split()
LONG_SENTENCE, SHORT_SENTENCE, RARE_COUNT, EPSILON = 20, 3, 5, 1e-10

# Word and label sets.
CONNECTIVES = "אבל,אולם,אם,אז,גם,או,כי,לכן,משום,בגלל,למרות,אלא,עם זאת,בנוסף,לעומת,כלומר,כך,אכן,הרי,שכן".split(",")
TERMINAL_MARKS = ". ! ? … :".split()
CONTENT_POS = "NOUN VERB ADJ ADV".split()
CLAUSE_RELATIONS = "rcmod ccomp xcomp advcl complm".split()
SUBORDINATE_RELATIONS = "ccomp xcomp advcl acl relcl".split()
AGREEMENT_RELATIONS = "nsubj amod".split()
PREFIX_LETTERS = "ובלכהמש"
SUFFIXES = "נו כם כן הם הן ו ה ם ן י".split()

# Document-level issues as (type, group, [(feature, weight, inverted)]), in order of emission.
ISSUES = [
    ("agreement_errors", "morphology", [("agreement_error_rate", 1.0, False)]),
    ("morphological_ambiguity", "morphology", [("morphological_ambiguity", 1.0, False)]),
    ("low_morphological_diversity", "morphology", [("binyan_entropy", 1.0, True)]),
    ("dependency_spread", "syntax", [("dependency_distance_variance", 1.0, False)]),
    ("excessive_branching", "syntax", [("right_branching_ratio", 1.0, False)]),
    ("low_lexical_diversity", "lexicon", [("lemma_diversity", 0.6, True), ("type_token_ratio", 0.4, True)]),
    ("rare_word_overuse", "lexicon", [("rare_word_ratio", 1.0, False)]),
    ("low_content_density", "lexicon", [("content_word_ratio", 1.0, True)]),
    ("sentence_length_variability", "structure", [("sentence_length_variance", 1.0, False)]),
    ("punctuation_issues", "structure", [("punctuation_ratio", 0.5, True), ("missing_terminal_punctuation_ratio", 0.5, False)]),
    ("fragmentation", "structure", [("short_sentence_ratio", 1.0, False)]),
    ("missing_connectives", "discourse", [("connective_ratio", 1.0, True)]),
    ("pronoun_ambiguity", "discourse", [("pronoun_to_noun_ratio", 1.0, False)]),
    ("structural_inconsistency", "style", [("pos_distribution_variance", 1.0, False)]),
    ("sentence_progression_drift", "style", [("sentence_length_trend", 1.0, False)]),
]
#: Place of each issue type in the order of emission; the two kinds per sentence stand first in their groups.
EMISSION = {
    t: i
    for i, t in enumerate(
        "agreement_errors morphological_ambiguity low_morphological_diversity sentence_complexity dependency_spread excessive_branching low_lexical_diversity rare_word_overuse "
        "low_content_density sentence_length_variability punctuation_issues fragmentation weak_cohesion missing_connectives pronoun_ambiguity structural_inconsistency sentence_progression_drift".split()
    )
}

# Diagnoses as (type, threshold, [(weight, how, issue or score)]).
DIAGNOSES = [
    ("low_lexical_diversity", 0.6, [(0.7, "max", "low_lexical_diversity"), (0.3, "max", "low_content_density")]),
    ("pronoun_overuse", 0.6, [(0.8, "max", "pronoun_ambiguity"), (0.2, "score", "cohesion")]),
    ("low_cohesion", 0.6, [(0.6, "max", "weak_cohesion"), (0.4, "max", "missing_connectives")]),
    ("sentence_over_complexity", 0.65, [(0.7, "mean", "sentence_complexity"), (0.3, "score", "difficulty")]),
    ("structural_inconsistency", 0.6, [(0.6, "max", "structural_inconsistency"), (0.4, "score", "fluency")]),
    ("low_morphological_richness", 0.6, [(0.7, "max", "low_morphological_diversity"), (0.3, "score", "complexity")]),
    ("fragmented_writing", 0.6, [(1.0, "max", "fragmentation")]),
    ("punctuation_deficiency", 0.6, [(1.0, "max", "punctuation_issues")]),
]
# Intervention type and focus features of each diagnosis.
INTERVENTIONS = {
    "low_lexical_diversity": ("vocabulary_expansion", "lemma_diversity type_token_ratio content_word_ratio"),
    "low_morphological_richness": ("vocabulary_expansion", "binyan_entropy type_token_ratio lemma_diversity"),
    "pronoun_overuse": ("pronoun_clarification", "pronoun_to_noun_ratio"),
    "sentence_over_complexity": ("sentence_simplification", "avg_sentence_length avg_tree_depth clauses_per_sentence"),
    "structural_inconsistency": ("sentence_simplification", "avg_sentence_length avg_tree_depth short_sentence_ratio"),
    "fragmented_writing": ("sentence_simplification", "avg_sentence_length short_sentence_ratio avg_tree_depth"),
    "low_cohesion": ("cohesion_improvement", "connective_ratio sentence_overlap"),
    "punctuation_deficiency": ("cohesion_improvement", "punctuation_ratio connective_ratio sentence_overlap"),
}
# Actions and exercises of the intervention of each diagnosis.
ACTIONS = {
    "low_lexical_diversity": ("Introduce synonym substitution exercises", "Encourage use of varied word forms", "Practice paraphrasing sentences with new vocabulary"),
    "low_morphological_richness": ("Introduce varied verb patterns (binyanim)", "Practice using different morphological forms", "Encourage construct-state (smichut) usage"),
    "pronoun_overuse": ("Replace ambiguous pronouns with explicit noun phrases", "Reduce pronoun density in consecutive sentences", "Clarify referential chains across paragraphs"),
    "sentence_over_complexity": ("Break long sentences into shorter units", "Reduce subordinate clause nesting", "Simplify deeply embedded syntactic structures"),
    "structural_inconsistency": ("Standardise sentence length across the text", "Reduce variation in syntactic patterns", "Align sentence structures for consistent readability"),
    "fragmented_writing": ("Combine short fragmented sentences into fuller ones", "Add connective phrases between fragments", "Develop sentence-expansion techniques"),
    "low_cohesion": ("Add discourse connectives between sentences", "Increase lexical overlap across adjacent sentences", "Use transitional phrases to link ideas"),
    "punctuation_deficiency": ("Review and correct punctuation usage", "Add missing terminal punctuation marks", "Use commas and periods to improve text flow"),
}
EXERCISES = {
    "low_lexical_diversity": ("Rewrite a paragraph replacing repeated words with synonyms", "Build a personal vocabulary list from reading texts", "Complete cloze passages using diverse word choices"),
    "low_morphological_richness": ("Conjugate verbs across multiple binyanim for the same root", "Rewrite sentences using construct-state noun phrases", "Identify and vary morphological patterns in a text"),
    "pronoun_overuse": ("Identify all pronouns in a paragraph and replace ambiguous ones", "Rewrite passages reducing pronoun-to-noun ratio", "Match pronouns to their antecedents in sample texts"),
    "sentence_over_complexity": ("Rewrite sentences exceeding 30 tokens into two or more", "Identify and extract embedded clauses", "Reduce tree depth by restructuring complex sentences"),
    "structural_inconsistency": ("Rewrite paragraphs to even out sentence lengths", "Identify outlier sentences and restructure them", "Practice writing with a target sentence-length range"),
    "fragmented_writing": ("Merge consecutive short sentences into compound sentences", "Expand sentence fragments with additional clauses", "Rewrite a paragraph to eliminate fragments"),
    "low_cohesion": ("Insert appropriate connectives into a passage", "Rewrite paragraphs to improve sentence-to-sentence overlap", "Identify missing transitions and add them"),
    "punctuation_deficiency": ("Punctuate an unpunctuated passage correctly", "Identify and fix punctuation errors in sample texts", "Practice using commas to separate clauses"),
}
