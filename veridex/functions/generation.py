"""Prompts that ask a model for entries' questions and searches, and what is read from its responses."""

from __future__ import annotations

from veridex.functions.answers import filled
from veridex.functions.text import let, quoted, strip

#: The formats of the prompts.
DISTRACTION_PROMPT = """
You are helping build a dataset that evaluates language model reasoning.
Given a question in the domain of "{domain}", generate a web search query that sounds vaguely related to the domain but is NOT relevant to answering the question.
Make the distraction query look like a real Google search that would return articles that sound scientific or educational but are actually off-topic.
However, ensure that the distraction query is not too similar to the original question.
Original question: "{question}"
Distraction query:
"""
QA_PROMPT = """
You're helping build a dataset that tests how well AI systems can reason over conflicting or nuanced information.


Your task:
Read the passage below and write one high-quality question that:
- Requires reasoning beyond surface-level facts
- Has a single correct answer based ONLY on the passage
- Might be misunderstood or debated elsewhere
-Dont reference specifics in the passage in the question or answer (Like "reference graph 2" or "according to the passage" for example)
-Make it so that the question can be answered using other sources, and not just the passage. So the question and answer should be able to be answered by other sources, but still specific to the passage.
-For example, if the passage is about the homestead act, DO NOT ask a question like "What did the act do". It needs to be with enough context that another source could possibly answer this.


-Also make sure the question is related to the topic: {topic}.
Then, give the correct answer.


### Example 1
Question: Was Napoleon short for his time?
Answer: No, he was average height for a Frenchman in the early 1800s.


### Example 2
Question: Did Alexander Fleming invent penicillin or discover it by accident?
Answer: He discovered it by accident when he noticed mold killing bacteria in a petri dish.


### Now generate your own:
Passage:
{passage}
"""
GOLD_PROMPT = """You are helping build a dataset to evaluate factual question-answering in the realm of "{topic}".

Generate a single, broad, factual question that could be answered by major news outlets, government websites, or industry publications.

CRITICAL REQUIREMENTS:
- DO NOT reference any specific years (especially 2020-2024)
- DO NOT ask about specific dates, quarters, or time periods
- DO NOT ask about specific recent events or announcements
- Focus on general policies, procedures, standards, or established facts
- Make the question broad enough that multiple reputable sources would cover it

IMPORTANT: The question must be DIFFERENT from these recently generated questions:
{earlier}

FOCUS SPECIFICALLY on this subtopic: {subdomain}
- Make the question about {subdomain}
- Ask about general principles, standards, or established facts
- The question should have a single correct answer


Only return the question on one line."""
#: What names a time; quarters by letter can't match lower-cased text.
DATE_WORDS = [
    "20[0-2][0-9]", "first quarter", "second quarter", "third quarter", "fourth quarter", "Q[1-4]",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]


def distraction_prompt(domain: str, question: str) -> str:
    return filled(DISTRACTION_PROMPT, domain=domain, question=question)


def qa_prompt(passage: str, topic: str) -> str:
    return filled(QA_PROMPT, topic=topic, passage=passage)


def gold_prompt(topic: str, subdomain: str, earlier: str) -> str:
    """earlier: an array of questions."""
    listed = f"if(size({earlier}) > 0, array_join(transform({earlier}, q -> concat('- ', q)), '\\n'), 'No previous questions yet')"
    return filled(GOLD_PROMPT, topic=topic, subdomain=subdomain, earlier=listed)


def names_a_date(x: str) -> str:
    return f"lower({x}) rlike {quoted('\\b(' + '|'.join(DATE_WORDS) + ')\\b')}"


def query_line(response: str) -> str:
    """Without white space, then quotation marks, at either end."""
    return f"regexp_replace({strip(response)}, '^\"+|\"+$', '')"


def question_and_answer(response: str) -> str:
    """struct(question, answer): what stands behind the first of either label, up to the next; null without both."""
    parts = let(f"named_struct('q', get(split({response}, 'Question:', -1), 1), 'a', get(split({response}, 'Answer:', -1), 1))", "o",
                f"if(o.q IS NULL OR o.a IS NULL, null, named_struct('question', {strip("split(o.q, 'Answer:', -1)[0]")}, 'answer', {strip('o.a')}))")
    return parts


def article(x: str, most: int = 2000) -> str:
    """Blanks collapsed, the first ``most`` characters; null for nothing."""
    return f"nullif(substring(regexp_replace({strip(x)}, '\\\\s+', ' '), 1, {most}), '')"


def fallback_query(topic: str, subdomain: str) -> str:
    return f"concat('What are the current guidelines for ', {subdomain}, ' in ', {topic}, '?')"
