"""Training-data operators over assessment rationales and web pages, and their queries."""
