"""PySpark-native curation engine for annotated multimodal datasets and large text corpora."""
