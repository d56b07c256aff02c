"""sparkloom: analytics and data-preparation operators written directly on Spark DataFrames."""
