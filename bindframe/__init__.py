"""PySpark operators for transcription-factor binding data."""
