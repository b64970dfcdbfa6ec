"""folkscope: survey, country and film-output analytics as Spark DataFrame operators."""
