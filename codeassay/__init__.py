"""Analytics over tables of model coding responses, as composable Spark DataFrame functions."""
