"""lexiscope: text-corpus analytics, detector evaluation and event reports as Spark jobs."""
