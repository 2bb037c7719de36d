"""Column contracts, the feature registry and the fixed values of the scoring rules."""

from __future__ import annotations

from pyspark.sql import types as T

TARGET = "stargazers_count"
LOG_TARGET = "log_stars"
EMBEDDING_DIM = 384

RAW_REPOS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("owner_login", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("stargazers_count", T.LongType()),
        T.StructField("watchers_count", T.LongType()),
        T.StructField("forks_count", T.LongType()),
        T.StructField("open_issues_count", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)

# One JSON document per repository: the repository, its owner, and the owner's listed repositories.
REPO_DOCUMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("forks_count", T.LongType()),
        T.StructField("open_issues_count", T.LongType()),
        T.StructField("stargazers_count", T.LongType()),
        T.StructField("created_at", T.StringType()),
        T.StructField(
            "owner",
            T.StructType(
                [
                    T.StructField("login", T.StringType()),
                    T.StructField("type", T.StringType()),
                    T.StructField("public_repos", T.LongType()),
                    T.StructField("created_at", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "owner_repos",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("stargazers_count", T.LongType()),
                        T.StructField("forks_count", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)

IMPORTANCE = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("pct", T.DoubleType()),
    ]
)

DATE_COLUMNS = ["created_at", "updated_at", "pushed_at", "ingested_at"]

# --- fixed values: feature names by family -----------------------------------------------------

METADATA_FEATURES = ["age_days", "forks_count", "open_issues_count", "size", "language"]

OWNER_MEASURES = [
    "owner_mean_stars",
    "owner_total_stars",
    "owner_repo_count",
    "owner_std_stars",
    "owner_mean_forks",
    "owner_total_forks",
    "owner_tenure_days",
    "owner_active_days",
    "owner_success_rate",
]
OWNER_FEATURES = OWNER_MEASURES + ["owner_is_org", "log_owner_total_stars", "log_owner_repo_count"]
OWNER_LOGGED = ["owner_total_stars", "owner_total_forks", "owner_repo_count", "owner_tenure_days"]

VELOCITY_RATES = ["stars_per_day", "forks_per_day", "issues_per_day"]
VELOCITY_RATIOS = ["fork_to_star_ratio", "issue_to_star_ratio"]
VELOCITY_FEATURES = VELOCITY_RATES + VELOCITY_RATIOS + [f"log_{r}" for r in VELOCITY_RATES]

# Features computed from the target itself.
LEAKING_FEATURES = [
    "stars_per_day",
    "log_stars_per_day",
    "fork_to_star_ratio",
    "issue_to_star_ratio",
    "stargazers_count",
]

# Columns the safe-feature list never judges, and name fragments it rejects.
NOT_FEATURES = ["stargazers_count", "log_stars", "id", "ingested_at", "created_at"]
LEAK_NAME_PARTS = ["watchers", "star", "subscribers"]

# --- fixed values: topic keywords, as regular expressions (training) ---------------------------

TOPIC_PATTERNS = {
    "topic_ai_llm": ["llm", "chatbot", "gpt", "claude", "llama", "mistral"],
    "topic_ai_transformer": ["transformer", "bert", "vit", "diffusion", "attention"],
    "topic_ai_rag": ["rag", "retrieval", "vector database", "pinecone", "embedding"],
    "topic_ai_agent": ["agent", "autonomous", "langchain", "crewai", "auto-gpt"],
    "topic_devops_k8s": ["kubernetes", "k8s", "helm", "istio"],
    "topic_devops_docker": ["docker", "container", "podman"],
    "topic_web_react": ["react", "nextjs", "next.js", "remix"],
    "topic_data_pytorch": ["pytorch", "torch", "pytorch lightning"],
    "topic_data_tensorflow": ["tensorflow", "tf", "keras"],
    "topic_data_pandas": ["pandas", "polars", "dask"],
}

# --- fixed values: topic keywords, as plain substrings (serving) -------------------------------

TOPIC_SUBSTRINGS = {
    "topic_ai_llm": ["llm", "chatbot", "gpt", "claude", "llama"],
    "topic_ai_transformer": ["transformer", "bert", "vit", "diffusion"],
    "topic_ai_rag": ["rag", "retrieval", "vector database", "embedding"],
    "topic_ai_agent": ["agent", "autonomous", "langchain", "crewai"],
    "topic_devops_k8s": ["kubernetes", "k8s", "helm"],
    "topic_devops_docker": ["docker", "container", "podman"],
    "topic_web_react": ["react", "nextjs", "next.js"],
    "topic_data_pytorch": ["pytorch", "torch"],
    "topic_data_tensorflow": ["tensorflow", "tf", "keras"],
    "topic_data_pandas": ["pandas", "polars", "dask"],
}

TOPIC_FEATURES = [*TOPIC_PATTERNS, "topic_count"]

# --- fixed values: organisation names ----------------------------------------------------------

ORG_KEYWORDS = [
    "microsoft",
    "google",
    "facebook",
    "amazon",
    "aws",
    "ibm",
    "apache",
    "tensorflow",
    "pytorch",
    "github",
    "docker",
]
ORG_REPO_COUNT = 100
SUCCESS_STARS = 100

# --- fixed values: language codes of the serving side ------------------------------------------

LANGUAGE_CODES = {
    "Python": 0,
    "JavaScript": 1,
    "Java": 2,
    "TypeScript": 3,
    "C++": 4,
    "C": 5,
    "HTML": 6,
    "CSS": 7,
    "PHP": 8,
    "Ruby": 9,
    "Go": 10,
    "Rust": 11,
    "Swift": 12,
    "Kotlin": 13,
    "Scala": 14,
    "Shell": 15,
    "Perl": 16,
    "Lua": 17,
    "R": 18,
    "MATLAB": 19,
    "Unknown": 99,
}
UNKNOWN_LANGUAGE_CODE = 99

# --- fixed values: profile of an owner nothing is known about ----------------------------------

OWNER_DEFAULTS = {
    "owner_mean_stars": 100.0,
    "owner_total_stars": 100.0,
    "owner_repo_count": 1.0,
    "owner_std_stars": 50.0,
    "owner_mean_forks": 20.0,
    "owner_total_forks": 20.0,
    "owner_tenure_days": 365.0,
    "owner_active_days": 365.0,
    "owner_success_rate": 0.1,
    "owner_is_org": 0.0,
}
EMPTY_LIST_STARS = 100
EMPTY_LIST_FORKS = 20

# --- fixed values: thresholds ------------------------------------------------------------------

MAX_AGE_DAYS = 3650
RISK_BANDS = [(0.9, "CRITICAL"), (0.7, "HIGH"), (0.5, "MODERATE")]
RISK_FLOOR = "LOW"
BASELINE_RMSLE = 0.6921
STAGE_RMSLE = {"metadata": 0.6921, "embeddings": 0.6639, "leaked": 0.1491}
HOLDOUT_CUTOFF = "2024-06-01"
SMALL_TEST_ROWS = 1000
ROWS_PER_FILE = 20000
TEXT_LIMIT = 2000
NO_TEXT = "No description available"
REPO_URL_PREFIX = "https://github.com/"
MODEL_VERSION = "v1.0_clean"


def embedding_columns(dim: int = EMBEDDING_DIM, prefix: str = "readme_emb") -> list[str]:
    return [f"{prefix}_{i}" for i in range(dim)]


def feature_names(clean: bool = True, embedding_dim: int = EMBEDDING_DIM) -> list[str]:
    """Model columns in training order; ``clean`` leaves out what is computed from the target."""
    velocity = [f for f in VELOCITY_FEATURES if not (clean and f in LEAKING_FEATURES)]
    return METADATA_FEATURES + embedding_columns(embedding_dim) + OWNER_FEATURES + TOPIC_FEATURES + velocity
