"""cinderbrook: composable PySpark operators that link disturbance events to environmental time series."""
