"""Defaults of the scan-dataset jobs.

Fixed values: these must stay as they are for results to match.
"""

# Inclusive id-number ranges of the official split.
OFFICIAL_RANGES = {"train": (1, 9000), "test": (9001, 9901)}

# Negatives drawn per split and the seed of the draw.
NEGATIVE_COUNTS = {"train": 309, "test": 50}
DEFAULT_SEED = 42

# Train subsamples: (size, seed).
SUBSAMPLES = [(350, 42), (50, 42), (50, 43), (50, 44), (50, 45), (50, 46)]

# Age brackets, left-closed.
AGE_EDGES = [0, 18, 30, 40, 50, 60, 70, 80, 120]
AGE_LABELS = ["<18", "18-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80+"]

# Label value meaning "uncertain".
UNCERTAIN = -1

# Texts a CSV field may hold to say "missing".
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Norm products below this are raised to it in cosine similarity.
COSINE_EPS = 1e-8
