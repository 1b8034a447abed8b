"""Scalar and array functions on probabilities, labels and text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constructs whose cost grows with the square of the rows, as patterns over generated code.
QUADRATIC = ("pairwise_distances", "cdist", "linkage", "AgglomerativeClustering", "SpectralClustering", "DBSCAN", "iterrows")
#: Rules of the secret and path scan.
TEXT_RULES = {"token_assignment": r"token = \"[0-9a-f]{8,}", "email": r"[a-z0-9.]+@[a-z0-9.]+\.com", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}"}
#: What every match of a rule holds.
TEXT_HINTS = {"token_assignment": 'token = "', "email": "@", "phone": "+1 ("}


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    """1 / (1 + e^-z), z held to [-50, 50]."""
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-50.0)), F.lit(50.0))))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Of an array, at a temperature, shifted by its maximum."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def finite_probability(p: Column) -> Column:
    """null and NaN to 0.5, infinities to the ends, the rest to [1e-6, 1 - 1e-6]."""
    return F.least(F.greatest(F.coalesce(F.nanvl(p, F.lit(0.5)), F.lit(0.5)), F.lit(1e-6)), F.lit(1 - 1e-6))


def align_classes(probabilities: Column, classes: list[str]) -> Column:
    """Array over all classes from a map class -> probability: missing classes get 1 / K, then the row is normalised."""
    raw = F.array(*[F.coalesce(F.try_element_at(probabilities, F.lit(c)), F.lit(1.0 / len(classes))) for c in classes])
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raw, lambda x: x / total)


def arg_max(values: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(values, F.array_max(values)).cast("int"))


def percent(x: Column) -> Column:
    """Fractions (at most 1.5 in size) as percent."""
    return F.when(F.abs(x) <= 1.5, x * 100).otherwise(x)


def safe_float(text: str) -> Column:
    """Text as double; N/A, NaN, empty and unparsable text are null."""
    t = F.trim(F.col(text))
    return F.when(~F.lower(t).isin("", "n/a", "nan", "none"), F.expr(f"try_cast(trim({text}) as double)"))


def truthy(text: str) -> Column:
    return F.lower(F.trim(F.col(text))).isin("1", "true", "yes", "y")


def mean_std(cell: str) -> tuple[Column, Column]:
    """Both numbers of a `mean±std` cell; the second is null if there is one number. A zero has no sign."""
    number = lambda i: F.regexp_extract(F.translate(F.col(cell), "−", "-"), r"(-?\d+(?:\.\d+)?)(?:\s*±\s*(\d+(?:\.\d+)?))?", i)
    return tuple(F.nullif(number(i), F.lit("")).try_cast("double") + F.lit(0.0) for i in (1, 2))


def half_up(x: str, digits: int) -> Column:
    """A double to that many decimals: ties of its shortest decimal form go away from zero, and a zero has no sign."""
    return F.round(F.col(x).cast("double"), digits) + F.lit(0.0)


def repaired(text: str) -> Column:
    """A ? between digits is a ± that an encoding lost."""
    return F.regexp_replace(F.col(text), r"(?<=\d)\?(?=\d)", "±")


def value_list(text: str) -> Column:
    """"[0.1, 0.2]" as an array of doubles."""
    return F.transform(F.split(F.regexp_replace(F.col(text), r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double"))


def safe_name(text: str) -> Column:
    return F.regexp_replace(F.col(text), "[^A-Za-z0-9_.-]+", "_")


def short_hash(text: str) -> Column:
    return F.substring(F.sha2(F.col(text), 256), 1, 16)


def clean_code(text: str) -> Column:
    """The text without fence and end marks, from its first line that opens with class, import or from (or all of it)."""
    bare = F.regexp_replace(F.col(text), r"```[a-z]*|<end>", "")
    lines = F.split(bare, "\n")
    first = F.array_position(F.transform(lines, lambda x: x.rlike(r"^(class|import|from)\b")), F.lit(True)).cast("int")
    return F.when(first > 0, F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines)), "\n")).otherwise(bare)


def without_thoughts(text: str) -> Column:
    return F.regexp_replace(F.col(text), r"(?s)<think>.*?</think>", "")


def drop_lines(text: str, words: tuple[str, ...]) -> Column:
    """The text without lines that hold one of the words or open a ### section."""
    pattern = "(?i)" + "|".join(words)
    return F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~(x.rlike(pattern) | x.startswith("###"))), "\n")


def embedded_json(text: str) -> Column:
    return F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0)


def binary_kd(teacher: Column, student: Column, temperature: float = 3.0) -> Column:
    """T^2 KL(softmax(t / T) || softmax(s / T)) of two logit arrays."""
    p, q = softmax(teacher, temperature), softmax(student, temperature)
    return temperature**2 * F.aggregate(F.zip_with(p, q, lambda a, b: a * (F.log(a) - F.log(b))), F.lit(0.0), lambda s, x: s + x)
