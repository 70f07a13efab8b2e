"""Fixed values of the data model: layers, ranks, limits, weights and policies."""

from __future__ import annotations

LAYERS = ("concept", "mechanism", "method", "condition", "scenario")
PREFIX_LAYER = {"IP": "concept", "MECH": "mechanism", "METHOD": "method", "COND": "condition", "SCENE": "scenario"}
LAYER_PAIRS = (("concept", "mechanism"), ("mechanism", "method"), ("method", "condition"), ("condition", "scenario"), ("method", "scenario"))

# limits of a plan
MAX_STEPS, MAX_DEPTH, MAX_TOP_K, MAX_RESULT, MAX_VISITED, MAX_CROSS_ENCODER = 20, 10, 500, 5000, 10_000, 50

SEED_MODES = ("alias", "attribute", "embedding", "id", "layer")
TARGETS = ("fact", "node", "segment")
DIRECTIONS = ("both", "inbound", "outbound")
COMBINE_METHODS = ("intersect", "subtract", "union")
AGGREGATES = ("count", "group", "rank", "rerank", "score")
RESERVED_EDGES = ("evidenced_by", "rst_adjacent", "tagged_in")

# scores of a source's rank: for scoring facts, and (others) for the evolution of candidates
SOURCE_AUTHORITY = {"S": 1.0, "A": 0.85, "B": 0.65, "C": 0.4}
CANDIDATE_AUTHORITY = {"S": 1.0, "A": 0.8, "B": 0.6, "C": 0.4}
EXTRACTION_METHOD = {"manual": 1.0, "rule": 0.85, "llm": 0.7}
FACT_WEIGHTS = (0.3, 0.2, 0.2, 0.2, 0.1)

RERANK_WEIGHTS = {"source_rank": 0.15, "confidence": 0.15, "anchor_coverage": 0.15, "rst_coherence": 0.1, "freshness": 0.1}
RERANK_KEYWORDS = 0.35

RST_PROPAGATION = {
    "Elaboration": 0.85, "Sequence": 0.85, "Exemplification": 0.8, "Causation": 0.7, "Constraint": 0.7,
    "Prerequisite": 0.65, "Evidence": 0.6, "Background": 0.6, "Condition": 0.5, "Contrast": 0.3,
}
RST_OTHER, RST_NUCLEUS_BONUS, RST_KEEP = 0.4, 0.05, 0.5
RST_PREDICATE = {"Constraint": "constrained_by", "Prerequisite": "requires", "Causation": "triggers", "Condition": "applies_when", "Exemplification": "has_example"}
CONTINUATIVE = ("Elaboration", "Sequence", "Causation", "Evidence", "Background", "Exemplification")
CHAINING = ("Elaboration", "Sequence", "Causation", "Background", "Exemplification")

IMPACT_POLICIES = {"causal": ("CAUSES", "IMPACTS"), "service": ("IMPACTS", "DEPENDS_ON"), "all": ("CAUSES", "IMPACTS", "DEPENDS_ON", "REQUIRES")}
IMPACT_TYPES = {"fault": "disrupted", "config_change": "affected", "alarm": "triggered"}
PATH_POLICIES = {"dependency": ("DEPENDS_ON", "REQUIRES"), "causal": ("CAUSES", "IMPACTS"), "all": None}

# admission gates of candidates
GATES = {"source_count": 3, "source_diversity": 0.6, "temporal_stability": 0.7, "structural_fit": 0.65, "composite": 0.65, "synonym_risk": 0.4}
AUTO_ACCEPT, MIN_POOL_DAYS = 0.85, 7
COMPOSITE_WEIGHTS = {"authority": 0.25, "diversity": 0.2, "stability": 0.2, "fit": 0.2, "gain": 0.1, "synonym": 0.05}

DEDUP_HAMMING, DEDUP_JACCARD, DEDUP_SEMANTIC = 3, 0.85, 0.9
INDEX_GATE = 0.5
