"""Prompts, responses, confidences and accuracies of models, as Spark SQL."""

from __future__ import annotations

from veridex.functions.text import is_refusal, let, quoted, soft_accuracy, strip

#: The formats of the prompts. The threshold is printed as 0.1, which is how 0.15 rounds.
ANSWER_PROMPT = """You are an expert assistant tasked with answering questions based on provided source materials.

Question: {question}

Source Materials:
{sources}

Instructions:
1. Answer the question based ONLY(VERY IMPORTANT) on the information provided in the sources above : DO NOT USE YOUR OWN KNOWLEDGE BASE OR SEARCH THE WEB.
2. If the sources contain conflicting information, acknowledge this in your response
3. If the sources don't contain enough information to answer confidently, say so
4. Use appropriate hedging language when uncertain (e.g., "likely", "probably", "possibly", etc.)
5. Do not exceed 75 words in your response.
6. Answer only if you are >{threshold} confident, if not, refuse. Since refusals will be awarded 0.4 points and having less than 0.2 accuracy will be penalized more than if you had refused using "I don't know" as your answer.
7. There should never be a case where you answer the question brutally wrong. If you believe you will answer the question wrong(<= 0.2 confidence), refuse with "I don't know" as your answer.

IMPORTANT: Structure your response exactly as follows:
- First line: Your direct answer to the question (keep this concise) but express uncertainty if necessary
- Remaining lines: Brief explanation of your reasoning and any uncertainties

"""
ASK_CONFIDENCE = '\n6. Provide a confidence score from 0.0 to 1.0: "Confidence: X.X"\n\nPlease provide your answer:'
ASK_ANSWER = "\n\nPlease provide your answer:"
TRUTH_PROMPT = """{sources}
Question: {question}
Proposed Answer: {answer}

Based ONLY on the sources provided, is the proposed answer correct?

CLASSIFICATION TASK: Respond with exactly one letter only.
A = True (correct)
B = False (incorrect)

Answer:"""
#: Fixed value: what the judge of an answer is told first.
TRUTH_SYSTEM_PROMPT = "You are a classification system. You judge factual correctness ONLY from provided sources. You must respond with exactly one letter: A (True) or B (False). Do not write sentences or explanations. Consider that sources may be incomplete or ambiguous."
GRADING_PROMPT = """You are an expert evaluator assessing the accuracy of AI-generated answers. 

Question: {question}

Gold Answer: {gold}

AI Answer: {answer}

Please evaluate how accurate the AI answer is compared to the gold answer. Consider:
1. Semantic similarity and meaning
2. Factual correctness
3. Completeness of information
4. Relevance to the question

Rate the accuracy on a scale from 0.0 to 1.0 where:
- 1.0 = completely accurate
- 0.8-0.9 = Very accurate with minor differences
- 0.6-0.7 = Mostly accurate with some differences
- 0.4-0.5 = Partially accurate, some correct information
- 0.2-0.3 = Mostly inaccurate, few correct elements
- 0.0-0.1 = Completely inaccurate or irrelevant

Be slightly lenient and respond with ONLY a number between 0.0 and 1.0 (e.g., "0.75")."""


def filled(template: str, **values: str) -> str:
    """SQL that puts the values' SQL into the template's slots."""
    parts, rest = [], template
    while True:
        slots = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not slots:
            break
        at, k = min(slots)
        parts += [quoted(rest[:at]), f"coalesce({values[k]}, '')"]
        rest = rest[at + len(k) + 2 :]
    return f"concat({', '.join([*parts, quoted(rest)])})"


def source_block(docs: str) -> str:
    """Numbered sources; date is Unknown unless given."""
    one = "concat('Source ', cast(i + 1 AS string), ':\\nTitle: ', coalesce(s.title, 'Unknown'), '\\nURL: ', coalesce(s.url, 'Unknown'), '\\nDate: Unknown\\nText: ', coalesce(s.text, ''), '\\n\\n')"
    return f"array_join(transform({docs}, (s, i) -> {one}), '')"


def answer_prompt(question: str, docs: str, model: str, threshold: str = "0.1") -> str:
    ask = f"if({model} LIKE 'gpt%' OR {model} LIKE 'mistral%' OR {model} LIKE 'llama%', {quoted(ASK_ANSWER)}, {quoted(ASK_CONFIDENCE)})"
    return f"concat({filled(ANSWER_PROMPT, question=question, sources=source_block(docs), threshold=quoted(threshold))}, {ask})"


def truth_prompt(question: str, answer: str, docs: str) -> str:
    block = f"if(size({docs}) > 0, concat('Sources:\\n', {source_block(docs)}), '')"
    return filled(TRUTH_PROMPT, question=question, answer=answer, sources=block)


def grading_prompt(question: str, gold: str, answer: str) -> str:
    return filled(GRADING_PROMPT, question=question, gold=gold, answer=answer)


#: How a response states its confidence, in the order in which they are tried.
CONFIDENCE_PATTERNS = [
    "(?i)confidence:\\s*([0-9]*\\.?[0-9]+)",
    "(?i)confidence\\s*=\\s*([0-9]*\\.?[0-9]+)",
    "(?i)([0-9]*\\.?[0-9]+)\\s*confidence",
    "(?i)confidence\\s*(?:score|level)?\\s*(?:is|of)?\\s*([0-9]*\\.?[0-9]+)",
]


def stated_confidence(response: str) -> str:
    """From 0 to 1, values above 1 taken as percent; null if none is stated."""
    found = ", ".join(f"nullif(regexp_extract({response}, {quoted(p)}, 1), '')" for p in CONFIDENCE_PATTERNS)
    return let(f"cast(coalesce({found}) AS double)", "v", "if(v IS NULL, null, greatest(0.0D, least(1.0D, if(v > 1, v / 100, v))))")


def parsed_response(response: str) -> str:
    """struct(answer, explanation): the first line with text and the others, lines of confidence left out."""
    lines = f"filter(transform(filter(split({strip(response)}, '\\n'), l -> NOT lower(l) rlike 'confidence:\\\\s*[0-9]*\\\\.?[0-9]+'), l -> {strip('l')}), l -> l <> '')"
    none = quoted("No explanation provided")
    return let(lines, "k", f"if(size(k) = 0, named_struct('answer', {strip(response)}, 'explanation', {none}), named_struct('answer', k[0], 'explanation', if(size(k) > 1, array_join(slice(k, 2, size(k) - 1), '\\n'), {none})))")


def model_client(model: str) -> str:
    """Which client serves a model; null if none."""
    return f"""CASE WHEN {model} LIKE 'gpt%' THEN 'openai' WHEN {model} LIKE 'claude%' THEN 'anthropic' WHEN {model} LIKE 'gemini%' THEN 'google'
        WHEN {model} LIKE 'mistral%' OR {model} LIKE '%Mixtral%' THEN 'mistral' WHEN {model} LIKE 'llama%' OR {model} LIKE '%Llama%' THEN 'llama'
        WHEN {model} LIKE 'deepseek%' OR {model} LIKE 'Qwen%' THEN 'mistral' END"""


def assigned_accuracy(answer: str, explanation: str, gold: str, skip: bool = False, grade: str | None = None) -> str:
    """0.4 for a refusal, null if grading is left out, the grader's number where there is a grader (SQL for its
    response), else 1 or 0 for an equal answer or not, 0.5 without both."""
    if skip:
        return f"if({is_refusal(answer)}, 0.4D, cast(null AS double))"
    same = f"if({strip(f'lower({answer})')} = {strip(f'lower({gold})')}, 1.0D, 0.0D)" if grade is None else graded_accuracy(f"({grade})", answer, gold)
    return f"CASE WHEN {is_refusal(answer)} THEN 0.4D WHEN coalesce({gold}, '') <> '' AND coalesce({answer}, '') <> '' THEN {same} ELSE 0.5D END"


def _two_way(a: str, b: str, text: str) -> str:
    """From the log probabilities of A and B; without both, what the text says."""
    value = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN exp({a}) / (exp({a}) + exp({b})) WHEN {a} IS NOT NULL THEN exp({a}) WHEN {b} IS NOT NULL THEN 1 - exp({b}) ELSE {text} END"
    return f"least(0.99D, greatest(0.01D, {value}))"


def truth_from_first_token(log_probs: str, text: str) -> str:
    """p(true) from the first token's alternatives; of several A or B the last counts; 0.5 without any token."""
    last = lambda x: f"try_element_at(transform(filter(l, t -> upper({strip('t.token')}) = '{x}'), t -> t.logprob), -1)"
    said = f"CASE upper({strip(text)}) WHEN 'A' THEN 0.9D WHEN 'B' THEN 0.1D ELSE 0.5D END"
    body = let(f"named_struct('a', {last('A')}, 'b', {last('B')})", "p", _two_way("p.a", "p.b", said))
    return f"if(coalesce(size({log_probs}), 0) <= 0, 0.5D, {let(f'{log_probs}[0].top_logprobs', 'l', body)})"


def truth_from_any_token(log_probs: str, text: str) -> str:
    """p(true) from the first A and the first B among all tokens' alternatives."""
    first = lambda x: f"try_element_at(transform(filter(l, t -> upper({strip('t.token')}) = '{x}'), t -> t.logprob), 1)"
    u = f"upper({strip(text)})"
    near = lambda x: f"contains({u}, '\\n({x})') OR endswith({u}, '{x}') OR contains({u}, '\\n{x}\\n') OR endswith({u}, '({x})')"
    said = f"CASE WHEN {near('A')} THEN 0.9D WHEN {near('B')} THEN 0.1D WHEN startswith({u}, 'A') THEN 0.9D WHEN startswith({u}, 'B') THEN 0.1D ELSE 0.5D END"
    body = let(f"named_struct('a', {first('A')}, 'b', {first('B')})", "p", _two_way("p.a", "p.b", said))
    return let(f"flatten(transform(coalesce({log_probs}, array()), t -> t.top_logprobs))", "l", body)


def truth_from_base_two(log_probs: str) -> str:
    """Two to the power of the first token's log probability, whichever token it is; 0.5 without one."""
    return f"if(coalesce(size({log_probs}), 0) <= 0, 0.5D, least(0.99D, greatest(0.01D, power(2.0D, {log_probs}[0].logprob))))"


def truth_from_samples(votes: str) -> str:
    """Share of A among sampled letters A and B; 0.5 without any."""
    return f"coalesce(try_divide(cast(size(filter({votes}, v -> v = 'A')) AS double), size(filter({votes}, v -> v IN ('A', 'B')))), 0.5D)"


def truth(client: str, log_probs: str, text: str) -> str:
    """p(true) as the model's client allows it; null without a client, so that a caller can fall back."""
    return f"""CASE {client} WHEN 'openai' THEN {truth_from_first_token(log_probs, text)} WHEN 'google' THEN {truth_from_any_token(log_probs, text)}
        WHEN 'mistral' THEN {truth_from_base_two(log_probs)} WHEN 'llama' THEN {truth_from_base_two(log_probs)} END"""


def graded_accuracy(grade: str, prediction: str, gold: str) -> str:
    """A grader's number from 0 to 1; what is no number, or missing, falls back to the words in common."""
    soft = soft_accuracy(prediction, gold)
    number = f"try_cast({strip(grade)} AS DOUBLE)"
    return f"CASE WHEN coalesce({prediction}, '') = '' OR coalesce({gold}, '') = '' THEN 0.0D WHEN {number} IS NULL OR isnan({number}) THEN {soft} ELSE greatest(0.0D, least(1.0D, {number})) END"


def output_name(model: str, suffix: str) -> str:
    return f"concat(replace({model}, '/', '_'), {quoted(suffix)})"
