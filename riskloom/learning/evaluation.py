"""Classification metrics, all derived from one pass that counts the confusion cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.labels import TIERS
from riskloom.operators.sampling import CLASSES


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per (label, prediction) pair that occurs."""
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(label, prediction)


def _cell(actual: int, predicted: int) -> str:
    return f"n_{actual}_{predicted}"


def confusion_cells(df: DataFrame, label: str, prediction: str, classes: Sequence[int] = CLASSES) -> DataFrame:
    """One row with a count for every pair of classes, 0 where there is none.

    Beside the pairs: rows and predictions of each class whatever stands on the other side
    (a null or an unlisted class is a miss), all rows, and rows that are in no pair.
    """
    pairs = [
        F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(_cell(a, p)) for a in classes for p in classes
    ]
    sides = [F.count_if(F.col(c) == k).alias(f"{name}_{k}") for c, name in ((label, "n_label"), (prediction, "n_predicted")) for k in classes]
    listed = F.col(label).isin(*classes) & F.col(prediction).isin(*classes)
    outside = F.count_if(~F.coalesce(listed, F.lit(False)))
    return df.agg(*pairs, *sides, F.count(F.lit(1)).alias("n_rows"), outside.alias("n_outside"))


def _rows(cells: DataFrame, structs: Sequence[Column]) -> DataFrame:
    return cells.select(F.inline(F.array(*structs)))


def confusion_matrix_dense(df: DataFrame, label: str, prediction: str, classes: Sequence[int] = CLASSES) -> DataFrame:
    """One row per actual class, one column per predicted class, and one for any other prediction."""
    cells = confusion_cells(df, label, prediction, classes)
    return _rows(
        cells,
        [
            F.struct(
                F.lit(a).alias("label"),
                *[F.col(_cell(a, p)).alias(f"predicted_{p}") for p in classes],
                (F.col(f"n_label_{a}") - _sum([F.col(_cell(a, p)) for p in classes])).alias("predicted_other"),
            )
            for a in classes
        ],
    )


def _sum(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


class _ClassCounts:
    """Expressions over the confusion cells for one class."""

    def __init__(self, k: int, classes: Sequence[int]):
        self.tp = F.col(_cell(k, k))
        self.support = F.col(f"n_label_{k}")
        self.fp = F.col(f"n_predicted_{k}") - self.tp
        self.fn = self.support - self.tp
        self.precision = _share(self.tp, self.tp + self.fp)
        self.recall = _share(self.tp, self.tp + self.fn)
        self.f1 = _share(2 * self.precision * self.recall, self.precision + self.recall)


def _counts(classes: Sequence[int]) -> list[_ClassCounts]:
    return [_ClassCounts(k, classes) for k in classes]


def _accuracy(classes: Sequence[int]) -> Column:
    return _share(_sum([F.col(_cell(k, k)) for k in classes]), F.col("n_rows"))


def _weighted(values: Sequence[Column], counts: Sequence[_ClassCounts]) -> Column:
    return _share(_sum([v * c.support for v, c in zip(values, counts)]), _sum([c.support for c in counts]))


def _mean(values: Sequence[Column]) -> Column:
    return _sum(list(values)) / len(values)


def eval_overall(df: DataFrame, label: str, prediction: str, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Accuracy over all rows, F1 weighted by class size, and the rows outside the classes."""
    counts = _counts(classes)
    return confusion_cells(df, label, prediction, classes).select(
        _accuracy(classes).alias("accuracy"),
        _weighted([c.f1 for c in counts], counts).alias("weighted_f1"),
        F.col("n_outside"),
    )


def eval_per_class(df: DataFrame, label: str, prediction: str, classes: Sequence[int] = CLASSES) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 of each class; an empty denominator gives 0."""
    structs = [
        F.struct(
            F.lit(k).alias("label"),
            c.tp.alias("tp"),
            c.fp.alias("fp"),
            c.fn.alias("fn"),
            c.precision.alias("precision"),
            c.recall.alias("recall"),
            c.f1.alias("f1"),
        )
        for k, c in zip(classes, _counts(classes))
    ]
    return _rows(confusion_cells(df, label, prediction, classes), structs)


def eval_macro_f1(df: DataFrame, label: str, prediction: str, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Mean F1 over all classes, those never seen or predicted included."""
    macro = _mean([c.f1 for c in _counts(classes)])
    return confusion_cells(df, label, prediction, classes).select(macro.alias("macro_f1"))


def classification_report(
    df: DataFrame,
    label: str,
    prediction: str,
    classes: Sequence[int] = CLASSES,
    names: Sequence[str] = tuple(TIERS),
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages."""
    counts = _counts(classes)
    total = F.col("n_rows")
    nothing = F.lit(None).cast("double")

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class_name"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    columns = [[c.precision for c in counts], [c.recall for c in counts], [c.f1 for c in counts]]
    lines = [line(n, c.precision, c.recall, c.f1, c.support) for n, c in zip(names, counts)]
    lines.append(line("accuracy", nothing, nothing, _accuracy(classes), total))
    lines.append(line("macro avg", *[_mean(v) for v in columns], total))
    lines.append(line("weighted avg", *[_weighted(v, counts) for v in columns], total))
    return _rows(confusion_cells(df, label, prediction, classes), lines)
