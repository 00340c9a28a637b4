"""equipoise."""
