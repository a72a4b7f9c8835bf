"""docforge"""
