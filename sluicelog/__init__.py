"""sluicelog: network-log analytics and data preparation as lazy Spark plans."""
