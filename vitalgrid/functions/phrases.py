"""Phrase lists the message rules depend on.

Fixed values: these lists decide the results, so they are stated in full and in order.
"""

CRISIS_PHRASES = [
    "kill myself", "killing myself", "wanna die", "wanna kill myself", "wanna end it", "wanna hurt myself",
    "want to die", "wants to die", "want to be dead", "end my life", "ending my life", "take my life",
    "taking my life", "commit suicide", "committed suicide", "attempting suicide", "suicidal", "suicide",
    "end it all", "not want to be here anymore", "don't want to be here", "dont want to be here",
    "don't want to live", "dont want to live", "do not want to live", "no reason to live", "ready to die",
    "better off dead", "wish i was dead", "wish i were dead", "i should be dead", "i want to be dead",
    "hurt myself", "hurting myself", "cut myself", "cutting myself", "harm myself", "harming myself",
    "self-harm", "self harm", "selfharm", "burn myself", "burning myself", "starving myself", "hit myself",
    "hitting myself",
    "no point in living", "no point anymore", "can't go on", "cannot go on", "cant go on",
    "can't take it anymore", "cannot take it anymore", "cant take it anymore", "life is not worth living",
    "life isn't worth living", "life isnt worth living", "isn't worth living", "isnt worth living",
    "not worth living", "nobody would care if i died", "nobody would miss me", "no one would miss me",
    "no one would care if i was gone", "nobody would notice if i was gone", "nobody would notice if i were gone",
    "better off without me", "everyone would be better off without me", "world would be better without me",
    "don't see the point of anything", "dont see the point", "nothing to live for", "give up on life",
    "giving up on life", "tired of living", "tired of being alive", "i give up", "there's no point",
    "theres no point",
    "overdose", "pills to die", "jump off a", "hang myself", "hanging myself", "shoot myself",
    "shooting myself", "drown myself", "drowning myself", "slit my wrist", "slit my wrists",
    "عايز أموت", "عاوز أموت", "نفسي أموت", "بفكر في الانتحار", "مش قادر أكمل", "مش قادر أكمّل",
    "تعبت من الحياة", "الحياة مش تستاهل", "نفسي أنهي حياتي", "أنهي حياتي", "اقتل نفسي", "أقتل نفسي",
    "مش عايز أعيش", "مش قادر أعيش", "ماعدش لاقي معنى", "مافيش معنى للحياة", "حياتي خلصت", "خلاص مش قادر",
    "مش عارف أكمل", "عايز أختفي", "نفسي أختفي",
]

SOFT_SIGNALS = [
    "can't live", "cannot live", "cant live", "don't want to live", "dont want to live",
    "don't want to be alive", "dont want to be alive", "tired of living", "tired of life", "no reason to live",
    "no reason to be here", "not worth living", "life is not worth",
    "disappear", "end it all", "end my life", "end everything", "feel like ending", "want to stop existing",
    "wish i wasn't here", "wish i was dead", "want to die", "wanna die", "ready to die", "just wanna die",
    "just want to die",
    "give up", "giving up on life", "can't go on", "cant go on", "cannot go on", "can't continue",
    "cant continue", "can't take it anymore", "cant take it anymore", "can't do this anymore",
    "cant do this anymore",
    "not worth it", "nobody cares", "better off without me", "better off dead", "everyone would be better",
    "what's the point", "whats the point", "no point anymore", "nothing matters", "pointless",
    "why am i even here",
    "hurt myself", "harm myself",
    "don't want to be here", "dont want to be here",
]

POSITIVE_SIGNALS = [
    "i feel great", "i'm happy", "i am happy", "i'm doing great", "i am doing great", "feeling good",
    "feeling great", "doing better", "i feel good", "something good happened", "happy now", "feel great",
    "things are better", "i feel better", "i'm feeling better", "i'm feeling good", "things got better",
    "good news", "great news", "i feel fine", "i'm fine now", "much better now", "feeling much better",
]

EMOTIONAL_STEMS = [
    "depress", "depressed", "depression", "anxious", "anxiety", "sad", "sadness", "lonely", "loneliness",
    "stressed", "stress", "hopeless", "hopelessness", "helpless", "worthless", "empty", "numb", "scared",
    "afraid", "terrified", "angry", "rage", "overwhelm", "panic", "grief", "grieving", "trauma", "hurt", "pain",
    "suffer", "suffering", "suicid", "die", "death", "cry", "crying", "tears", "breakdown", "burnout", "exhaust",
]

SHORT_REPLIES = [
    "yes", "no", "yeah", "nope", "yep", "ok", "okay", "sure", "maybe", "idk", "hmm", "hm", "alright", "fine",
    "good", "thanks", "thank you", "not really", "i don't know", "i dont know", "kind of", "sort of", "i guess",
    "perhaps", "probably",
]

QUESTION_PHRASES = ["what is", "what are", "how do", "how can", "explain", "tell me", "define", "difference"]

TOPIC_SHIFTS = [
    "different question", "switching topics", "new topic", "change of topic", "forget that", "never mind",
    "totally different", "unrelated topic", "moving on", "let me ask something else", "one more thing,",
    "different thing,", "by the way,", "wait,",
]

FORMULA_OPENERS = [
    "i'm so sorry to hear", "i am so sorry to hear", "i'm sorry to hear", "i am sorry to hear",
    "it sounds incredibly", "it's completely understandable", "it is completely understandable",
    "i can imagine how", "i can only imagine",
]

SCORED_OPENERS = [*FORMULA_OPENERS, "that must be so", "i want you to know", "thank you for sharing"]

REFUSAL_PHRASES = [
    "i can't continue this conversation", "i cannot continue this conversation",
    "i'm not able to continue this conversation", "if you are experiencing thoughts of self-harm",
    "if you're experiencing thoughts of self-harm", "please seek help from a qualified mental health",
    "seek immediate help from a mental health professional", "i'm unable to assist with this request",
    "i am unable to assist with this request",
]

REFUSAL_PREFIXES = [
    "i can't provide a response", "i cannot provide a response", "i'm not able to provide",
    "i am not able to provide", "i'm unable to", "i am unable to", "i cannot answer", "i can't answer",
    "i'm not able to answer",
]

CLOSINGS_EN = [
    "What's been on your mind lately?", "How are you feeling about that?", "What's the hardest part right now?",
    "Would you like to talk more about it?", "What does that feel like for you?",
    "How long have you been feeling this way?",
]

CLOSINGS_AR = [
    "ما الذي يشغل بالك مؤخراً؟", "كيف تشعر حيال ذلك؟", "ما أصعب جزء في هذا الأمر بالنسبة لك؟",
    "هل تريد أن تتحدث عن ذلك أكثر؟", "كيف يبدو ذلك بالنسبة لك؟", "منذ متى وأنت تشعر بهذا؟",
]

WARM_PHRASES = [
    "i hear you", "that sounds", "yeah", "that makes sense", "it's okay", "you're not alone", "i understand",
    "that can be really", "thank you for sharing", "that must be", "i can imagine", "that's really", "i'm here",
    "makes total sense",
]

CLINICAL_PHRASES = [
    "according to the dsm", "as per dsm-5", "criterion a", "criterion b", "diagnostic and statistical manual",
    "icd-10", "f32", "dsm-5-tr criterion", "the diagnostic criteria state", "clinically significant disturbance",
    "specifier",
]

EMPATHY_PHRASES = [
    "i hear you", "that makes sense", "that's a lot", "sounds like", "feel", "understand", "heavy", "hard",
    "difficult", "exhausting", "carry", "makes sense", "yeah", "really", "tough", "rough", "struggling",
    "going through", "overwhelming",
]

TOPIC_WORDS = [
    "feel", "emotion", "mental", "anxiety", "depression", "stress", "therapy", "cope", "mind", "thought", "mood",
    "support", "health", "wellbeing", "help", "talk", "here", "you",
]

CRISIS_INDICATORS = [
    "08008880700", "988", "crisis", "hotline", "reach out", "help", "support", "not alone", "someone", "nefsi",
    "iasp", "08008",
]

REDIRECT_PHRASES = [
    "only here", "mental health", "not really my area", "can't help with that", "cannot help with that",
    "i'm here for", "emotional", "help you with",
]

TITLE_STOP_WORDS = [
    "i", "me", "my", "we", "our", "you", "your", "the", "a", "an", "it", "its", "this", "that", "these", "those",
    "he", "she", "his", "her", "they", "them", "their", "to", "of", "in", "on", "at", "for", "with", "from", "by",
    "into", "and", "or", "but", "so", "if", "as", "about", "than", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "can", "could", "should", "shall", "may",
    "might", "am", "get", "got", "getting", "what", "whats", "how", "why", "who", "when", "where", "which",
    "difference", "between", "versus", "compared", "tell", "explain", "describe", "feel", "feeling", "felt",
    "feels", "know", "knowing", "think", "thinking", "want", "need", "help", "really", "very", "just", "like",
    "also", "even", "still", "now", "more", "some", "any", "all", "not", "no", "too", "there", "here", "up", "out",
    "going", "time", "one", "day", "lot", "much", "well",
]

RERANK_STOP_WORDS = [
    "the", "a", "an", "is", "it", "of", "and", "or", "in", "to", "i", "me", "my", "do", "what", "how", "feel",
]

RELEVANCE_STOP_WORDS = [
    "what", "that", "this", "have", "with", "from", "just", "feel", "like", "been", "about", "does", "more", "some",
    "when", "will", "know", "dont", "cant", "want", "help", "everything", "something", "anything",
]

BACKEND_ALIASES = {
    "vertex_tuned": ["vertex", "vertex_tuned", "tuned", "llama"],
    "auto": ["auto", "mixed", "ensemble", "hybrid"],
}
DEFAULT_BACKEND = "gemini"

SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[BOS]", "[EOS]"]
PAD, UNK, BOS, EOS = 0, 1, 2, 3
STOP_MARKERS = ["<|eot_id|>", "<|end_of_text|>", "<|start_header_id|>"]
ROLE_PREFIXES = ["Human:", "Assistant:", "human:", "assistant:"]
