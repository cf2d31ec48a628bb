"""moodframe: emotion signals in learner-written text, as Spark DataFrame jobs.

Subpackages
-----------
functions   Column expressions (cleaning, tokenising, keyword scoring, arrays).
sources     Table loaders, derived views and file readers.
operators   DataFrame jobs: prediction, storage, analytics, datasets, features,
            evaluation, model training.
plans       Named query registry and DuckDB oracle SQL.
streaming   Structured Streaming versions of the interaction jobs.
"""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
