"""Sources and sinks: delimited text, JSON products, office packages, manifests."""
