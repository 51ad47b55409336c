"""Column expressions over text: tokens, identifiers, redaction, normal forms and digests.

All are built-in expressions, so they stay inside generated code and are pushed or pruned like any other projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

#: Words that the lexical index leaves out.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may "
    "might must shall can this that these those i you he she it we they"
).split()

#: File extensions and their languages.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp",
    ".c": "c", ".h": "c", ".hpp": "cpp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin",
    ".scala": "scala", ".r": "r", ".m": "objectivec", ".mm": "objectivec", ".cs": "csharp", ".vue": "vue", ".svelte": "svelte",
}

#: Directories that are no part of a codebase.
SKIPPED_DIRS = ".git node_modules __pycache__ .venv venv env .env dist build .next .nuxt coverage .pytest_cache .mypy_cache".split()

#: What is redacted, in this order, and what takes its place ($1: what the first group found).
SECRETS = [
    (r"(sk-[a-zA-Z0-9]{20,})", "sk-***REDACTED***"),
    (r"(sk-ant-[a-zA-Z0-9-]{20,})", "sk-ant-***REDACTED***"),
    (r"(?i)(api[_-]?key[\"\s:=]+)[\"']?([a-zA-Z0-9_-]{20,})[\"']?", "$1***REDACTED***"),
    (r"(?i)(token[\"\s:=]+)[\"']?([a-zA-Z0-9_-]{20,})[\"']?", "$1***REDACTED***"),
    (r"(?i)(password[\"\s:=]+)[\"']?([^\s\"']+)[\"']?", "$1***REDACTED***"),
    (r"(?i)(secret[\"\s:=]+)[\"']?([a-zA-Z0-9_-]{10,})[\"']?", "$1***REDACTED***"),
    (r"(?i)(bearer\s+)([a-zA-Z0-9_.-]+)", "$1***REDACTED***"),
]

#: What a text must have, in small letters, for each pattern of SECRETS to find anything.
SECRET_LITERALS = ["sk-", "sk-ant-", "api", "token", "password", "secret", "bearer"]

#: What users are told about an exception class.
SAFE_MESSAGES = {
    "ConnectionError": "Unable to connect to external service",
    "TimeoutError": "Request timed out",
    "AuthenticationError": "Authentication error",
    "RateLimitError": "Rate limit exceeded",
    "APIError": "External API error",
    "ValueError": "Invalid input provided",
    "FileNotFoundError": "Required file not found",
    "PermissionError": "Permission denied",
}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _stopped(words: Column) -> Column:
    return F.filter(words, lambda p: (p != "") & ~p.isin(*STOP_WORDS))


def _compound_terms(word: Column) -> Column:
    """The word in small letters and, once for each rule that parts it, its parts without stop words."""
    low = F.lower(word)
    camel = F.regexp_replace(F.regexp_replace(word, "([a-z])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    none = F.array().cast("array<string>")
    parts = F.when(F.contains(low, F.lit("_")), _stopped(F.split(low, "_"))).otherwise(none)
    more = F.when(F.contains(camel, F.lit("_")), _stopped(F.split(F.lower(camel), "_"))).otherwise(none)
    return F.concat(F.array(low), parts, more)


def word_terms(word: Column) -> Column:
    """The terms of one word; most words are plain, and only the others meet the rules for compounds."""
    low = F.lower(word)
    plain = (low == word) & ~F.contains(word, F.lit("_"))
    compound = F.when(word.rlike("_|[a-z][A-Z]|[A-Z][A-Z][a-z]"), _compound_terms(word)).otherwise(F.array(low))
    return F.when(plain, F.array(low)).otherwise(compound)


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(WORD), F.lit(0))


def is_stop_word(word: Column) -> Column:
    return F.lower(word).isin(*STOP_WORDS)


def lexical_tokens(text: Column | str) -> Column:
    """Words in small letters without stop words; compounds also give their parts (snake parts once more by the camel rule). For whole
    tables, `retrieval.terms` gives the same tokens as rows, which is faster."""
    return F.flatten(F.transform(F.filter(words(text), lambda w: ~is_stop_word(w)), word_terms))


def identifier_words(name: Column | str) -> Column:
    """The words of a SCREAMING, snake, camel or mixed identifier, in small letters; digits stand alone."""
    spaced = F.regexp_replace(col(name), "_+", " ")
    for pattern in ("(?<=[a-z])(?=[A-Z])", "(?<=[A-Z])(?=[A-Z][a-z])", "(?<=[A-Za-z])(?=[0-9])", "(?<=[0-9])(?=[A-Za-z])"):
        spaced = F.regexp_replace(spaced, pattern, " ")
    return F.filter(F.split(F.lower(spaced), r"\s+"), lambda w: w != "")


def readable(words: Column | str) -> Column:
    return F.array_join(col(words), " ")


def redacted(text: Column | str) -> Column:
    """The text with its secrets replaced; a pattern runs only on texts that have its literal."""

    def step(pattern: str, to: str, literal: str):
        return lambda t: F.when(F.contains(F.lower(t), F.lit(literal)), F.regexp_replace(t, pattern, to)).otherwise(t)

    out = col(text)
    for (pattern, to), literal in zip(SECRETS, SECRET_LITERALS, strict=True):
        out = F.get(F.transform(F.array(out), step(pattern, to, literal)), F.lit(0))
    return out


def safe_message(error_class: Column | str, context: str = "Operation") -> Column:
    known = F.create_map(*[F.lit(x) for kv in SAFE_MESSAGES.items() for x in kv])
    return F.concat(F.lit(f"{context} failed: "), F.coalesce(F.try_element_at(known, col(error_class)), F.lit("An unexpected error occurred")))


def extension(path: Column | str) -> Column:
    """The last extension with its dot, in small letters; empty if there is none (a leading dot begins no extension)."""
    return F.lower(F.regexp_extract(F.substring_index(col(path), "/", -1), r"^.+(\.[^.]+)$", 1))


def language(path: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("text"))


def is_code_file(path: Column | str) -> Column:
    skipped = F.arrays_overlap(F.split(col(path), "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRS]))
    return ~skipped & extension(path).isin(*LANGUAGES)


def token_estimate(text: Column | str) -> Column:
    return F.floor(F.length(col(text)) / 4).cast("int")


def line_count(text: Column | str) -> Column:
    return F.size(F.split(col(text), "\n", -1))


def layout_key(text: Column | str) -> Column:
    """How running headers and footers compare: digits alike, trimmed, small letters."""
    return F.lower(F.trim(F.regexp_replace(col(text), r"\d+", "#")))


def claim_key(text: Column | str) -> Column:
    """How claims compare: small letters, words only, single spaces, 100 characters."""
    bare = F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}_\s]", "")
    return F.left(F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit(100))


def code_hash(snippet: Column | str) -> Column:
    """MD5 of the snippet with every run of white space as one space."""
    return F.md5(F.trim(F.regexp_replace(col(snippet), r"\s+", " ")))


def paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(text), r"\n\s*\n"), F.trim), lambda p: p != "")


def sentences(text: Column | str) -> Column:
    return F.split(col(text), r"(?<=[.!?])\s+")


def dotted_calls(code: Column | str) -> Column:
    """Distinct dotted calls in order of appearance, ten at most."""
    return F.slice(F.array_distinct(F.regexp_extract_all(col(code), F.lit(r"([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)\s*\("), F.lit(1))), 1, 10)


def inline_comments(code: Column | str) -> Column:
    found = F.transform(F.regexp_extract_all(col(code), F.lit(r"(?m)(?://|#)\s*(.+)$"), F.lit(1)), F.trim)
    return F.slice(F.filter(found, lambda c: F.length(c) > 3), 1, 5)


def doc_comments(code: Column | str) -> Column:
    """Triple-quoted strings, block comments, #' lines and %{ %} blocks, in this order."""
    patterns = [r'(?s)"""(.*?)"""', r"(?s)'''(.*?)'''", r"(?s)/\*\*(.*?)\*/", r"(?m)^\s*#'\s?(.*)$", r"(?s)%\{(.*?)%\}"]
    found = F.concat(*[F.regexp_extract_all(col(code), F.lit(p), F.lit(1)) for p in patterns])
    return F.filter(F.transform(found, F.trim), lambda d: d != "")


def line_comments(code: Column | str) -> Column:
    """Line comments of three words or more that aren't housekeeping."""
    found = F.concat(*[F.regexp_extract_all(col(code), F.lit(p), F.lit(1)) for p in (r"(?m)(?:^|\s)#(?!['!])\s*(.+)$", r"(?m)//\s*(.+)$", r"(?m)(?:^|\s)%\s+(.+)$", r"(?m)--\s+(.+)$")])
    noise = r"(?iu)^(todo|fixme|xxx|hack|noqa|type:|pylint|pragma|copyright|license|eslint)"
    return F.filter(F.transform(found, F.trim), lambda c: (F.size(F.split(c, r"\s+")) >= 3) & ~c.rlike(noise))


def definition_names(code: Column | str) -> Column:
    """The words of the names that are defined, one string for each distinct name."""
    patterns = [r"\bdef\s+(\w+)", r"\bclass\s+(\w+)", r"\bfunction\s+(\w+)", r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(", r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)", r"\bfn\s+(\w+)", r"\b(?:struct|interface|trait|enum)\s+(\w+)", r"(?m)^\s*(\w+)\s*<-\s*function"]
    names = F.array_distinct(F.concat(*[F.regexp_extract_all(col(code), F.lit(p), F.lit(1)) for p in patterns]))
    trivial = ["main", "init", "__init__", "self", "test", "run", "setup", "get", "set"]
    return F.transform(F.filter(names, lambda n: ~F.lower(n).isin(*trivial)), lambda n: readable(identifier_words(n)))


def first_sentence(docs: Column) -> Column:
    """The first line of three words or more among the doc comments, without trailing dots; null if there is none."""
    lines = F.transform(F.flatten(F.transform(docs, lambda d: F.split(d, "\n"))), lambda x: F.trim(F.regexp_replace(x, r"^[\s*]+", "")))
    good = F.filter(lines, lambda x: (F.size(F.split(x, r"\s+")) >= 3) & ~x.rlike(r"^[@:]"))
    return F.regexp_replace(F.get(good, F.lit(0)), r"\.+$", "")


#: Code idioms and what they do, by group. This is a core table; `described_operations` takes any longer list, and `idioms_from` reads one.
IDIOMS = [
    ("reshape", "reshapes a tensor"), ("permute", "reorders tensor dimensions"), ("transpose", "swaps dimensions"), ("matmul", "matrix multiplication"),
    ("einsum", "Einstein summation"), ("softmax", "normalises scores to probabilities"), ("relu", "rectified linear activation"), ("sigmoid", "sigmoid activation"),
    ("Conv2d", "two-dimensional convolution"), ("Linear", "fully connected layer"), ("Embedding", "embedding lookup"), ("LayerNorm", "layer normalisation"),
    ("MultiheadAttention", "multi-head attention"), ("CrossEntropyLoss", "cross-entropy loss"), ("MSELoss", "mean squared error loss"), ("Adam", "Adam optimiser"),
    ("SGD", "stochastic gradient descent"), ("Dropout", "dropout regularisation"), ("MaxPool2d", "max pooling"), ("train_test_split", "splits data into training and test sets"),
    ("StandardScaler", "standardises features"), ("KFold", "k-fold cross-validation"), ("GridSearchCV", "grid search over hyperparameters"), ("PCA", "principal component analysis"),
    ("fillna", "fills missing values"), ("groupby", "groups rows by key"), ("merge", "joins tables"), ("solve_ivp", "solves an initial value problem"), ("fft", "fast Fourier transform"),
    ("autograd", "automatic differentiation"), ("sinkhorn", "optimal transport"), ("random_forest", "random forest"),
    ("view(", "reshapes a tensor without copying"), ("squeeze", "removes dimensions of size one"), ("concatenate", "joins arrays along an axis"), ("torch.cat", "joins tensors along a dimension"),
    ("torch.stack", "stacks tensors along a new dimension"), ("chunk(", "splits a tensor into pieces"), ("gather(", "picks elements by index"), ("scatter", "writes elements by index"),
    ("broadcast_to", "repeats an array to a shape"), ("np.linalg.inv", "matrix inverse"), ("np.linalg.svd", "singular value decomposition"), ("eigh", "eigenvalues of a symmetric matrix"),
    ("cholesky", "Cholesky decomposition"), ("lstsq", "least squares solution"), ("norm(", "vector or matrix norm"), ("cross_entropy", "cross-entropy loss"), ("nll_loss", "negative log-likelihood loss"),
    ("kl_div", "Kullback-Leibler divergence"), ("smooth_l1", "smooth absolute error"), ("triplet", "triplet loss"), ("contrastive", "contrastive loss"), ("log_softmax", "log probabilities"), ("gelu", "Gaussian error linear activation"),
    ("leaky_relu", "leaky rectified activation"), ("tanh", "hyperbolic tangent activation"), ("BatchNorm", "batch normalisation"), ("GroupNorm", "group normalisation"), ("Conv1d", "one-dimensional convolution"),
    ("ConvTranspose", "transposed convolution"), ("LSTM", "long short-term memory layer"), ("GRU", "gated recurrent layer"), ("TransformerEncoder", "transformer encoder"), ("scaled_dot_product_attention", "scaled dot-product attention"),
    ("AvgPool", "average pooling"), ("AdaptiveAvgPool", "pooling to a fixed size"), ("AdamW", "Adam optimiser with decoupled weight decay"), ("RMSprop", "RMSprop optimiser"), ("lr_scheduler", "learning rate schedule"),
    ("CosineAnnealing", "cosine learning rate schedule"), ("clip_grad_norm", "gradient clipping"), ("zero_grad", "clears gradients"), ("backward()", "computes gradients"), ("no_grad", "turns gradients off"), ("DataLoader", "loads batches"),
    ("RandomCrop", "random crop augmentation"), ("RandomHorizontalFlip", "random flip augmentation"), ("Normalize(", "normalises channels"), ("MinMaxScaler", "scales features to a range"), ("OneHotEncoder", "one-hot encoding"),
    ("LabelEncoder", "encodes labels as numbers"), ("LogisticRegression", "logistic regression"), ("LinearRegression", "linear regression"), ("SVC", "support vector classifier"), ("KMeans", "k-means clustering"), ("DBSCAN", "density-based clustering"),
    ("TSNE", "t-SNE embedding"), ("UMAP", "UMAP embedding"), ("XGB", "gradient-boosted trees"), ("LGBM", "gradient-boosted trees"), ("CatBoost", "gradient-boosted trees"), ("cross_val_score", "cross-validation scores"), ("roc_auc_score", "area under the ROC curve"),
    ("f1_score", "F1 score"), ("accuracy_score", "accuracy"), ("confusion_matrix", "confusion matrix"), ("dropna", "drops missing values"), ("pivot", "reshapes a table"), ("rolling", "moving window statistics"), ("resample", "changes the time step of a series"),
    ("interp", "interpolation"), ("minimize(", "numerical minimisation"), ("odeint", "integrates differential equations"), ("curve_fit", "fits a curve"), ("convolve", "convolution"), ("butter", "Butterworth filter"), ("bootstrap", "bootstrap resampling"),
    ("ttest", "t-test"), ("multivariate_normal", "multivariate normal distribution"), ("Categorical(", "categorical distribution"), ("Tokenizer", "tokenisation"), ("word2vec", "word embeddings"), ("GCNConv", "graph convolution"), ("message_passing", "message passing on a graph"),
    ("vae", "variational autoencoder"), ("discriminator", "adversarial discriminator"), ("diffusion", "diffusion model"), ("q_learning", "Q-learning"), ("replay_buffer", "experience replay"), ("epsilon_greedy", "epsilon-greedy exploration"), ("beam_search", "beam search"),
    ("early_stopping", "early stopping"), ("mixup", "mixup augmentation"), ("quantize", "quantisation"), ("prune", "pruning"), ("distill", "knowledge distillation"), ("torch.jit", "compiles a model"), ("vmap", "vectorises a function"), ("pmap", "runs a function on several devices"),
]


def idioms_from(table: DataFrame) -> list[tuple[str, str]]:
    """The rows (seq, pattern, description) of a table of idioms, in order; a table of a few thousand rows, since each is an expression."""
    return [(r["pattern"], r["description"]) for r in table.orderBy("seq").collect()]


def described_operations(code: Column | str, idioms: list[tuple[str, str]] = IDIOMS, whole_words: bool = False) -> Column:
    """Distinct descriptions of the idioms that the code contains, in any case, in the table's order. With whole_words an idiom must stand
    as an identifier of its own."""

    def hit(pattern: str) -> Column:
        if whole_words:
            return col(code).rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_])\Q{pattern}\E(?![\p{{L}}\p{{N}}_])")
        return F.contains(F.lower(col(code)), F.lit(pattern.lower()))

    return F.array_distinct(F.array_compact(F.array(*[F.when(hit(p), F.lit(d)) for p, d in idioms])))


def search_query(code: Column | str) -> Column:
    """What code is searched by: operations, first doc sentence, comments and names, or the code itself if it has none."""
    parts = F.concat_ws(" ", F.array_join(described_operations(code), " "), first_sentence(doc_comments(code)), F.array_join(line_comments(code), " "), F.array_join(definition_names(code), " "))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(parts, r"\s+", " ")), F.lit("")), col(code))


def phrases(code: Column | str) -> Column:
    lines = F.flatten(F.transform(doc_comments(code), lambda d: F.split(d, "\n")))
    lines = F.filter(F.transform(lines, F.trim), lambda x: F.size(F.split(x, r"\s+")) >= 3)
    return F.concat(lines, line_comments(code), definition_names(code))
