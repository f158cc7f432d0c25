"""Typed inputs for the registered queries: driver tables -> ERP frames -> normalised frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..constants import FEATURE_COLS
from ..operators import normalize
from ..sources import testdata


@dataclass
class Inputs:
    spark: SparkSession
    sf_dir: str

    @property
    def invoices_raw(self) -> DataFrame:
        return testdata.invoice_history(self.spark, self.sf_dir)

    @property
    def invoices(self) -> DataFrame:
        """N3-N5 applied."""
        return normalize.invoice_history(self.invoices_raw)

    @property
    def customers_raw(self) -> DataFrame:
        return testdata.customer_master(self.spark, self.sf_dir)

    @property
    def customers(self) -> DataFrame:
        return testdata.customer_dim(self.spark, self.sf_dir)

    @property
    def gl_raw(self) -> DataFrame:
        return testdata.gl_cash_positions(self.spark, self.sf_dir)

    @property
    def gl(self) -> DataFrame:
        return normalize.gl_cash(self.gl_raw)

    @property
    def feature_store(self) -> DataFrame:
        from ..operators.features import build_feature_store
        from ..session import materialize

        return materialize(lambda: build_feature_store(self.customers, self.invoices, self.gl), "feature_store",
                           self.sf_dir, self.spark)

    @property
    def aging(self) -> DataFrame:
        from ..operators.aging import ar_aging

        return ar_aging(self.invoices)

    @property
    def threshold(self) -> float:
        from ..operators.scoring import DEFAULT_THRESHOLD

        return DEFAULT_THRESHOLD

    @property
    def scored(self) -> DataFrame:
        """Feature store scored with the stand-in probability (C7 applied)."""
        from ..operators import scoring

        return scoring.predict(scoring.standin_probability(self.feature_store), self.threshold)

    @property
    def scored_split(self) -> DataFrame:
        """The split scored with the stand-in probability (columns are pruned to what a query reads)."""
        from ..operators import scoring

        return scoring.predict(scoring.standin_probability(self.split), self.threshold)

    @property
    def scored_test(self) -> DataFrame:
        from pyspark.sql import functions as F

        return self.scored_split.where(F.col("split") == "test")

    @property
    def customers_eda(self) -> DataFrame:
        """P29 customer view: late rate over cleared invoices (missing = 0) and tier."""
        from ..operators.portfolio import customer_risk_view

        return customer_risk_view(self.customers, self.invoices)

    @property
    def customer_totals_eda(self) -> DataFrame:
        """Cleared invoices summed per customer, with the EDA segments and tier attached."""
        from ..operators.portfolio import customer_totals

        view = self.customers_eda.select("KUNNR", "INDUSTRY", "REGION", "RISK_TIER")
        return customer_totals(self.invoices).join(view, "KUNNR", "left")

    @property
    def aging_eda(self) -> DataFrame:
        return normalize.aging_eda_fields(self.aging)

    @property
    def gl_eda(self) -> DataFrame:
        return normalize.gl_eda_fields(self.gl_raw)

    @property
    def customer_months(self) -> DataFrame:
        """Invoices reduced to (customer, status, month), with N8 segments and M1 tier."""
        from ..operators.monthly import attach_segments, customer_months

        return attach_segments(customer_months(self.invoices), self.customers.select("KUNNR", "INDUSTRY", "REGION"))

    @property
    def monthly(self) -> DataFrame:
        """Monthly series of every slice (at most slices x months rows), materialised."""
        from ..operators.monthly import monthly_dataset
        from ..session import materialize

        return materialize(lambda: monthly_dataset(self.customer_months, self.gl, self.scored), "monthly",
                           self.sf_dir, self.spark)

    # ---- trained models (fitted once per session and data directory) --------------------------
    def _memo(self, name, build):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _MODELS:
            _MODELS[key] = build()
        return _MODELS[key]

    @property
    def split(self) -> DataFrame:
        """The feature store with its time split: a projection with literal bounds (found once per
        session), so it needs no table of its own."""
        from ..operators.features import time_split

        return self._memo("split", lambda: time_split(self.feature_store))

    @property
    def classifier(self):
        """C2-C6 fitted on the train split; saved under the checkpoint folder."""
        from pyspark.sql import functions as F

        from ..operators.classify import train_classifier
        from ..operators.features import category_mapping

        def build():
            train = self.split.where(F.col("split") == "train").drop("split")
            model = train_classifier(train)
            model.publish(self._classifier_path, category_mapping(self.feature_store))
            return model

        return self._memo("classifier", build)

    @property
    def _classifier_path(self) -> str:
        from ..session import models_dir

        return f"{models_dir(self.spark, 'classifier', self.sf_dir)}/{self.spark.sparkContext.applicationId}"

    @property
    def cv_auc(self) -> float:
        """Mean AUC over the folds of the fitting rows, computed once per session and saved with the model."""
        from pyspark.sql import functions as F

        from ..operators import classify

        def build():
            cut = classify.validation_cut(self.split.where(F.col("split") == "train").drop("split"))
            model = self.classifier
            model.cv_auc = classify.cross_validate(cut.where(~F.col("is_val")).drop("is_val"), classify.ClassifierConfig(cv_rounds=model.gbt.getNumTrees))
            model.save_meta(self._classifier_path)
            return model.cv_auc

        return self._memo("cv_auc", build)

    @property
    def model_scored(self) -> DataFrame:
        """Feature store scored by the trained classifier (C7), with the split column."""
        from ..session import materialize

        return materialize(lambda: self.classifier.predict(self.split), "model_scored", self.sf_dir, self.spark)


_MODELS: dict = {}


def _forecaster(inp: "Inputs"):
    from ..operators.forecast import train_forecaster

    return inp._memo("forecaster", lambda: train_forecaster(inp.monthly))


Inputs.forecaster = property(_forecaster)


# FIXED VALUES: weights of the linear stand-in scorer, one per model feature (with enough digits that no
# product of a count falls half-way between two rounded values)
LINEAR_WEIGHTS = [0.91371723, -0.02197341, 0.11391127, -0.15139733, 0.03177129, 2.51791337, -0.01193947, 0.0000113717,
                  0.05197119, -0.20193131, 0.04177713, 0.30192741]


def _split_node(node_id: int, feature: str, cut: float, left: int, right: int) -> dict:
    split = {"featureIndex": FEATURE_COLS.index(feature), "leftCategoriesOrThreshold": [cut], "numCategories": -1}
    return {"id": node_id, "leftChild": left, "rightChild": right, "split": split, "prediction": 0.0}


def _leaf_node(node_id: int, prediction: float) -> dict:
    return {"id": node_id, "leftChild": -1, "rightChild": -1, "split": None, "prediction": prediction}


# FIXED VALUES: a small forest by hand, as the stand-in for the fitted one (cuts that no feature value equals)
HAND_FOREST = [
    (1.0, [_split_node(0, "CUST_LATE_RATE", 0.6137, 1, 4), _split_node(1, "LOG_AMOUNT", 11.70317, 2, 3), _leaf_node(2, -0.8), _leaf_node(3, 0.15),
           _split_node(4, "CUST_AVG_DAYS_LATE", 12.3719, 5, 6), _leaf_node(5, 0.6), _leaf_node(6, 1.7)]),
    (0.5, [_split_node(0, "PAYMENT_DAYS_NUM", 30.5, 1, 2), _leaf_node(1, -0.3), _split_node(2, "CUST_INVOICE_COUNT", 6.5, 3, 4), _leaf_node(3, 0.45),
           _split_node(4, "CUST_LATE_RATE", 0.7391, 5, 6), _leaf_node(5, -0.2), _leaf_node(6, 0.9)]),
    (0.25, [_split_node(0, "CUST_AVG_AMOUNT", 140321.77, 1, 2), _split_node(1, "INVOICE_MONTH", 6.5, 3, 4), _leaf_node(2, 0.35), _leaf_node(3, -0.55), _leaf_node(4, 0.1)]),
]
HAND_BACKGROUND = 16


def hand_forest() -> list[tuple[float, dict]]:
    """``HAND_FOREST`` as ``classify.tree_nodes`` returns fitted trees."""
    return [(w, {n["id"]: n for n in nodes}) for w, nodes in HAND_FOREST]


def _forest_attributions(inp: "Inputs"):
    """X2 of the stand-in forest over the whole feature store, by the operator of the fitted model."""
    from ..operators import attribution

    def build():
        bg = attribution.background(inp.feature_store, n=HAND_BACKGROUND)
        return attribution.tree_shapley(attribution.tree_leaves(hand_forest()), inp.feature_store, bg)

    return inp._memo("forest_attr", build)


def _report_attributions(inp: "Inputs"):
    """X2 on the top-N flagged invoices, memoised."""
    from ..operators import attribution

    def build():
        top = attribution.top_flagged(inp.model_scored)
        bg = attribution.background(inp.feature_store)
        phi, base = attribution.model_shapley(inp.classifier, top, bg)
        return top, phi, base

    return inp._memo("report_attr", build)


def _portfolio_attributions(inp: "Inputs"):
    """X2 over every feature-store invoice (portfolio views)."""
    from ..operators import attribution

    def build():
        bg = attribution.background(inp.feature_store)
        return attribution.model_shapley(inp.classifier, inp.feature_store, bg)

    return inp._memo("portfolio_attr", build)


def _linear_attributions(inp: "Inputs"):
    """X2 of the linear stand-in scorer against one background row, over the whole feature store
    (the contributions are then w * (x - z), which SQL can tell)."""
    from ..operators import attribution

    def build():
        bg = attribution.background(inp.feature_store, n=1)
        return attribution.shapley(attribution.linear_scorer(LINEAR_WEIGHTS), inp.feature_store, bg, n_samples=2)

    return inp._memo("linear_attr", build)


Inputs.report_attributions = property(_report_attributions)
Inputs.portfolio_attributions = property(_portfolio_attributions)
Inputs.linear_attributions = property(_linear_attributions)
Inputs.forest_attributions = property(_forest_attributions)
