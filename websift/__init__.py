"""websift: a PySpark-native analytics engine for captured web-page corpora."""
