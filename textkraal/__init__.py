"""textkraal: DataFrame operators that curate and analyse text corpora on Spark."""
