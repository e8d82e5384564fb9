"""DataFrame -> DataFrame operators. None of them starts a Spark job unless it says so."""
