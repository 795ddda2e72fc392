"""Spark-native building and analysis of question-answering benchmarks."""
