"""A PySpark-native engine for catalogue analytics: parsing, rules, retrieval, grading and reports."""
