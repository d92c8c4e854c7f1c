"""tutorgauge: curate fine-tuning conversations and score the teachers that wrote them, on Spark.

Every public function takes DataFrames and options and returns a DataFrame.
"""
