"""hornbeam: software supply-chain analytics and corpus preparation on Spark."""
