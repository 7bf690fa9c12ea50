"""Analytics and search over a corpus of notes and documents, on Spark."""
